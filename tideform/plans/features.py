"""The feature language: typed definitions over quotes and closed bars, compiled to DataFrame columns.

A definition is OP:argument:...; arguments are names of other definitions, whole numbers or $parameters. Every value has a
version, the sequence number of the latest tick it rests on, and is evaluated once for each version. A definition over bars is
therefore a column of a table with one row for each closing of a bar it reads (its clock), a few rows beside the tape's
ticks; one over quotes has the ticks as its clock and meets bars by keys. Values are missing until they are ready.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideform.functions.folds import ema_int
from tideform.functions.scans import Average, averages

# Names of operators.
QUOTES = ("BID", "ASK", "SPREAD")
BARS = ("OPEN", "HIGH", "LOW", "CLOSE")
WINDOWED = ("LAG", "EMA", "HIGHEST", "LOWEST")
NUMERIC, COMPARED, LOGICAL = ("ADD", "SUB", "MIN", "MAX"), ("GT", "GE", "LT", "LE", "EQ", "CROSS_UP", "CROSS_DOWN"), ("AND", "OR")
MOST_NODES, LONGEST_WINDOW, LONGEST_BAR_MS = 1024, 100_000, 86_400_000
BLOCK = 8_192  # ticks that a task sorts at once for an operator that looks back over quotes

Clock = frozenset  # of bar periods in ms; with 0 among them the ticks are the clock


@dataclass(frozen=True)
class Node:
    name: str
    op: str
    inputs: tuple[str, ...] = ()
    parameter: int = 0
    boolean: bool = False
    clock: Clock = field(default_factory=frozenset)


def compile_graph(definitions: dict[str, str], outputs: list[str], parameters: dict[str, int] | None = None) -> list[Node]:
    """Definitions in an order in which each follows its inputs.

    Raises ValueError for a cycle, an unknown name or operator, wrong numbers or types of arguments, a number out of range,
    and a definition that no output needs.
    """
    done: dict[str, Node] = {}
    open_: set[str] = set()

    def number(text: str, low: int, high: int) -> int:
        if text.startswith("$") and text[1:] not in (parameters or {}):
            raise ValueError(f"unknown parameter {text}")
        try:
            value = int(parameters[text[1:]] if text.startswith("$") else text)
        except ValueError:
            raise ValueError(f"not a whole number: {text}") from None
        if not low <= value <= high:
            raise ValueError(f"out of range: {text}")
        return value

    def visit(name: str) -> Node:
        if name in done:
            return done[name]
        if name in open_:
            raise ValueError(f"cycle at {name}")
        if name not in definitions:
            raise ValueError(f"unknown definition {name}")
        open_.add(name)
        op, *args = definitions[name].split(":")
        names = {**dict.fromkeys(QUOTES, 0), **dict.fromkeys(BARS, 0), "CONST": 0, **dict.fromkeys(WINDOWED, 1), "NOT": 1, **dict.fromkeys((*NUMERIC, *COMPARED, *LOGICAL), 2)}
        if op not in names:
            raise ValueError(f"unknown operator {op}")
        numbers = int(op in (*BARS, "CONST", *WINDOWED))
        if len(args) != names[op] + numbers:
            raise ValueError(f"{op} takes {names[op] + numbers} arguments")
        inputs = [visit(a) for a in args[: names[op]]]
        wants = True if op in (*LOGICAL, "NOT") else None if op == "LAG" else False
        if wants is not None and any(i.boolean != wants for i in inputs):
            raise ValueError(f"{op} takes {'conditions' if wants else 'numbers'}")
        low, high = (1, LONGEST_BAR_MS) if op in BARS else (1, LONGEST_WINDOW) if op in WINDOWED else (-(2**63), 2**63 - 1)
        parameter = number(args[-1], low, high) if numbers else 0
        clock = Clock().union(*(i.clock for i in inputs)) if inputs else Clock({parameter} if op in BARS else {0} if op in QUOTES else ())
        boolean = op in (*COMPARED, *LOGICAL, "NOT") or op == "LAG" and inputs[0].boolean
        open_.discard(name)
        done[name] = Node(name, op, tuple(i.name for i in inputs), parameter, boolean, Clock({0}) | clock if 0 in clock else clock)
        if len(done) > MOST_NODES:
            raise ValueError("too many definitions")
        return done[name]

    for name in outputs:
        visit(name)
    if unused := sorted(set(definitions) - set(done)):
        raise ValueError(f"unused: {', '.join(unused)}")
    return list(done.values())


def closings(ticks: DataFrame, period_ms: int) -> DataFrame:
    """Closed bars as they become visible: at the first tick of the next one. One row a bar; ``version`` is its last tick."""
    at = Window.partitionBy("symbol").orderBy("first_seq")
    bars = ticks.groupBy("symbol", "session_day", F.expr(f"ts_ns div {period_ms * 1_000_000}").alias("bucket")).agg(
        F.min_by("bid_u", "seq").alias("open"), F.max("bid_u").alias("high"), F.min("bid_u").alias("low"), F.max_by("bid_u", "seq").alias("close"), F.min("seq").alias("first_seq"), F.max("seq").alias("version"))
    seen = bars.select("symbol", F.lead("first_seq").over(at).alias("seen"), *(F.col(c).alias(f"{c}_{period_ms}") for c in ("open", "high", "low", "close")))
    return seen.where("seen is not null")


class Graph:
    """Evaluates compiled definitions over ticks (symbol, seq, ts_ns, session_day, bid_u, ask_u)."""

    def __init__(self, ticks: DataFrame, nodes: list[Node]) -> None:
        # One clock of ticks, with all the bars that any definition over quotes reads.
        quoted = Clock().union(*(n.clock for n in nodes if 0 in n.clock))
        nodes = [replace(n, clock=quoted) if 0 in n.clock else n for n in nodes]
        self.ticks, self.nodes = ticks, {n.name: n for n in nodes}
        self.tables: dict[Clock, DataFrame] = {}
        for node in nodes:
            if node.clock:
                self._add(node)

    def _table(self, clock: Clock) -> DataFrame:
        """Rows of a clock: (symbol, seen), with the latest closed bar of each of its periods; ``seen`` is a sequence number."""
        if clock not in self.tables:
            if 0 in clock:
                table = self.ticks.select("symbol", F.col("seq").alias("seen"), "session_day", "ts_ns", "bid_u", "ask_u")
                for p in sorted(clock - {0}):  # where the bar that is open at a tick began: what closed there is what it sees
                    bucket = F.expr(f"ts_ns div {p * 1_000_000}")
                    began = self.ticks.groupBy("symbol", "session_day", bucket.alias(f"bucket_{p}")).agg(F.min("seq").alias(f"began_{p}"))
                    table = table.withColumn(f"bucket_{p}", bucket).join(began, ["symbol", "session_day", f"bucket_{p}"], "left").drop(f"bucket_{p}")
            else:
                table = None
                for p in sorted(clock):
                    one = closings(self.ticks, p)
                    table = one if table is None else table.join(one, ["symbol", "seen"], "full")
                if len(clock) > 1:
                    table = self._filled(table, [c for c in table.columns if c not in ("symbol", "seen")])
            self.tables[clock] = table
        return self.tables[clock]

    @staticmethod
    def _filled(table: DataFrame, columns: list[str]) -> DataFrame:
        past = Window.partitionBy("symbol").orderBy("seen").rowsBetween(Window.unboundedPreceding, 0)
        return table.withColumns({c: F.last(c, True).over(past) for c in columns})

    def _bring(self, clock: Clock, name: str) -> None:
        """Make a value of a smaller clock a column of this one: its latest row, by key for ticks, else by filling forward."""
        node, table = self.nodes[name], self._table(clock)
        if not node.clock or name in table.columns:
            return
        other = self._table(node.clock).select("symbol", F.col("seen").alias("seen_2") if 0 in clock else "seen", name)
        if 0 in clock:
            began = F.greatest(*(F.col(f"began_{p}") for p in node.clock), F.lit(0))
            table = table.withColumn("seen_2", began).join(other, ["symbol", "seen_2"], "left").drop("seen_2")
        else:
            table = self._filled(table.join(other, ["symbol", "seen"], "left"), [name])
        self.tables[clock] = table

    def _value(self, name: str) -> Column:
        node = self.nodes[name]
        return F.lit(node.parameter).cast("bigint") if node.op == "CONST" else F.col(name)

    def _add(self, node: Node) -> None:
        for i in node.inputs:
            self._bring(node.clock, i)
        table = self._table(node.clock)
        a, *rest = [self._value(i) for i in node.inputs] or [None]
        b = rest[0] if rest else None
        plain = {
            "BID": lambda: F.col("bid_u"), "ASK": lambda: F.col("ask_u"), "SPREAD": lambda: F.col("ask_u") - F.col("bid_u"), "NOT": lambda: ~a, "ADD": lambda: a + b, "SUB": lambda: a - b,
            "MIN": lambda: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), "MAX": lambda: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
            "GT": lambda: a > b, "GE": lambda: a >= b, "LT": lambda: a < b, "LE": lambda: a <= b, "EQ": lambda: a == b,
            "AND": lambda: F.when(a.isNotNull() & b.isNotNull(), a & b), "OR": lambda: F.when(a.isNotNull() & b.isNotNull(), a | b),
        }
        if node.op in BARS:
            table = table.withColumn(node.name, F.col(f"{node.op.lower()}_{node.parameter}"))
        elif node.op in plain:
            table = table.withColumn(node.name, plain[node.op]())
        elif node.op == "EMA":
            table = self._smoothed(table, node, a)
        else:
            table = self._looking_back(table, node, a, b)
        self.tables[node.clock] = table

    def _smoothed(self, table: DataFrame, node: Node, a: Column) -> DataFrame:
        """Over bars in one pass a symbol; over quotes block by block, each from the value that the ones before it lead to."""
        rows = table.select("symbol", "seen", a.alias("a"))
        if 0 in node.clock:
            own = averages(rows.where("a is not null"), "seen", [Average(node.name, "a", "ema_int", node.parameter)]).drop("a")
            return table.join(own, ["symbol", "seen"], "left")

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            f = frame.sort_values("seen")
            out = ema_int(f["a"].to_numpy(), node.parameter)
            return pd.DataFrame({"symbol": f["symbol"], "seen": f["seen"], node.name: out})[node.parameter - 1 :]

        own = rows.where("a is not null").groupBy("symbol").applyInPandas(run, f"symbol string, seen bigint, {node.name} bigint")
        return table.join(own, ["symbol", "seen"], "left")

    def _looking_back(self, table: DataFrame, node: Node, a: Column, b: Column | None) -> DataFrame:
        """LAG, HIGHEST, LOWEST and crosses: values become ready once and stay so, hence rows before are versions before."""
        reach = node.parameter if node.op in WINDOWED else 1
        keys = ["symbol"]
        if 0 in node.clock:  # blocks of ticks, each with the end of the one before; sequence numbers have no gaps
            size = max(BLOCK, 2 * reach)
            spread = F.array_distinct(F.array(F.expr(f"seen div {size}"), F.expr(f"(seen + {reach}) div {size}")))
            table = table.withColumn("block", F.explode(spread))
            keys.append("block")
        order = Window.partitionBy(*keys).orderBy("seen")
        if node.op == "LAG":
            value = F.lag(a, reach).over(order)
        elif node.op in ("HIGHEST", "LOWEST"):
            frame = order.rowsBetween(1 - reach, 0)
            value = F.when(F.count(a).over(frame) == reach, (F.max if node.op == "HIGHEST" else F.min)(a).over(frame))
        else:
            before_a, before_b = F.lag(F.when(b.isNotNull(), a)).over(order), F.lag(F.when(a.isNotNull(), b)).over(order)
            crossed = (before_a <= before_b) & (a > b) if node.op == "CROSS_UP" else (before_a >= before_b) & (a < b)
            value = F.when(before_a.isNotNull() & before_b.isNotNull() & a.isNotNull() & b.isNotNull(), crossed)
        table = table.withColumn(node.name, value)
        return table.where(f"block = seen div {size}").drop("block") if 0 in node.clock else table

    def values(self, *names: str) -> DataFrame:
        """``(symbol, seen, version, names...)`` by the clock of all the names: a row for each version of any of them.

        ``seen`` is the tick that first sees the values, ``version`` the one they rest on.
        """
        clock = Clock().union(*(self.nodes[n].clock for n in names))
        for n in self.nodes.values():
            clock = n.clock if 0 in clock and 0 in n.clock else clock
        for n in names:
            self._bring(clock, n)
        version = F.col("seen") if 0 in clock else F.col("seen") - 1
        return self._table(clock).select("symbol", "seen", version.alias("version"), *(self._value(n).alias(n) for n in names))


def signals(values: DataFrame, name: str, each_update: bool = False) -> DataFrame:
    """Rows of bar clocks at which a condition holds: at each version, or only where it did not hold at the one before."""
    before = F.coalesce(F.lag(name).over(Window.partitionBy("symbol").orderBy("seen")), F.lit(False))
    return values.withColumn("before", before).where(F.col(name) if each_update else F.col(name) & ~F.col("before")).select("symbol", "seen", "version")
