"""Declarative plans: named steps composed into one statement, so that the optimizer sees the whole query.

Steps are written in the SQL that Spark and the checking engine share; the few functions whose names differ are written as
tokens and filled in for either. A step or a final SELECT may also be a pair (Spark, checking engine): what Spark does in
several stages to spread the work is then checked by the plain statement of the same thing, and a step that only Spark needs
has None there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tideform.sources.written import written

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: token: (Spark, checking engine); \1 is the token's argument.
TOKENS = {
    r"~div~": ("div", "//"),
    r"MICROS\((\w+)\)": (r"unix_micros(CAST(\1 AS TIMESTAMP))", r"epoch_us(\1)"),
    r"DAYNUM\((\w+)\)": (r"CAST(date_format(\1, 'yyyyMMdd') AS BIGINT)", r"CAST(strftime(\1, '%Y%m%d') AS BIGINT)"),
    # Monday is 1; a day is a number like 20240131.
    r"WEEKDAYOF\((\w+)\)": (r"CAST(weekday(to_date(CAST(\1 AS STRING), 'yyyyMMdd')) + 1 AS BIGINT)", r"CAST(isodow(strptime(CAST(\1 AS VARCHAR), '%Y%m%d')) AS BIGINT)"),
    r"PAIROF\(": ("struct(", "row("),
    r"SHA\(": ("sha2(CAST(256 AS INT), ", "sha256("),
    r"SPAN\((\w+), (\w+)\)": (r"explode(sequence(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT)))", r"unnest(generate_series(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT)))"),
    r"SERIES\((\d+), (\d+)\)": (r"explode(sequence(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT)))", r"unnest(generate_series(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT)))"),
    r"LASTKNOWN\((\w+)\)": (r"last(\1, true)", r"last_value(\1 IGNORE NULLS)"),
    r"QUANTILE\((\w+), ([\d.]+)\)": (r"percentile(\1, \2)", r"quantile_cont(\1, \2)"),
    # Letters beyond ASCII (Latin, Greek, Cyrillic and further alphabets up to U+1FFF) are parts of words.
    r"WORDS\((\w+)\)": (r"explode(split(trim(regexp_replace(lower(\1), '[^a-z0-9À-ɏͰ-῿]+', ' ')), ' '))", r"unnest(string_split(trim(regexp_replace(lower(\1), '[^a-z0-9À-ɏͰ-῿]+', ' ', 'g')), ' '))"),
    r"EACHMATCH\((\w+), ('[^']*')\)": (r"explode(regexp_extract_all(\1, r\2, 1))", r"unnest(regexp_extract_all(\1, \2, 1))"),
    # A bucket of hours as civil time seven hours earlier; that time in New York as London's; the hour of a civil time.
    r"BACK7\((\w+)\)": (r"CAST(timestamp_seconds((\1 - 7) * 3600) AS TIMESTAMP_NTZ)", r"CAST(make_timestamp((\1 - 7) * 3600000000) AS TIMESTAMP)"),
    r"ZONED\((\w+)\)": (r"convert_timezone('America/New_York', 'Europe/London', \1)", r"timezone('Europe/London', timezone('America/New_York', \1))"),
    r"HOUROF\(": ("hour(", "hour("),
    r"FAILED\(": ("raise_error(", "error("),
    r"MATCHES\((\w+), ('[^']*')\)": (r"(\1 RLIKE \2)", r"regexp_matches(\1, \2)"),
}


def _counted(text: str) -> str:
    """count_if(x) as a filtered count, whose type is the same in both engines."""
    while (at := text.find("count_if(")) >= 0:
        depth, end = 0, at + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            if not depth:
                break
            end += 1
        text = f"{text[:at]}count(*) FILTER (WHERE {text[at + len('count_if(') : end]}){text[end + 1 :]}"
    return text


def dialect(text: str, spark: bool) -> str:
    """Text for one engine. Numbers with a point are doubles in both, not decimals."""
    text = _counted(text)
    for token, forms in TOKENS.items():
        text = re.sub(token, forms[0 if spark else 1], text)
    text = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", text)
    return re.sub(r"sha2\(CAST\(256 AS INT\), (\w+)\)", r"sha2(\1, 256)", text)


Text = str | tuple[str | None, str | None]

#: Steps that a statement names again and again and that cost a shuffle: written once, then read, where named more than once.
WRITTEN = ("ticks",)


class Plan:
    """A final SELECT over named steps; a step is (name, text)."""

    def __init__(self, *steps: tuple[str, Text], select: Text) -> None:
        self.steps: dict[str, Text] = {}
        for name, text in steps:
            if self.steps.setdefault(name, text) != text:
                raise ValueError(f"step {name} is defined twice")
        self.select = select

    @staticmethod
    def _of(text: Text, spark: bool) -> str | None:
        return text if isinstance(text, str) else text[0 if spark else 1]

    def text(self, spark: bool, given: frozenset[str] = frozenset()) -> str:
        """The statement; steps that are ``given`` exist as tables."""
        steps = {n: self._of(t, spark) for n, t in self.steps.items() if n not in given}
        body = ",\n".join(f"{n} AS ({t})" for n, t in steps.items() if t)
        return dialect((f"WITH {body}\n" if body else "") + self._of(self.select, spark), spark)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        text, made = self.text(True), {}
        for name in WRITTEN:
            if name in self.steps and len(re.findall(rf"\b(?:FROM|JOIN) {name}\b", text)) > 1:
                at = list(self.steps).index(name)
                before = Plan(*list(self.steps.items())[: at + 1], select=f"SELECT * FROM {name}")
                made[name] = written(before.run(spark, sf_dir), name)
        given = frozenset(made)
        if given:
            text = self.text(True, given)
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)} | made
        if used:  # only then is the text a template
            text = text.replace("{", "{{").replace("}", "}}")
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return spark.sql(text, **used)
