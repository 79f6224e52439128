"""What happens to a broken level: replacement, first return, touch and close reclaim, the retest rules, and its identity.

A level is in force until another replaces it, and on each side a bar has one level in force. So one pass over the bars of each
level, at most two rows a bar, tells for each of them the next that matters, and every event looks up its own by equi joins.
"""

#: How long each pair of levels was in force; the next pair replaces it.
REPLACED = ("replaced", """
SELECT symbol, bar AS from_bar, high_id, low_id, lead(bar) OVER (PARTITION BY symbol ORDER BY bar) AS replaced_at FROM (
  SELECT symbol, bar, high_id, low_id, lag(high_id) OVER w AS h0, lag(low_id) OVER w AS l0 FROM levels WINDOW w AS (PARTITION BY symbol ORDER BY bar))
WHERE (high_id IS NOT NULL OR low_id IS NOT NULL) AND (h0 IS NULL AND high_id IS NOT NULL OR l0 IS NULL AND low_id IS NOT NULL OR h0 <> high_id OR l0 <> low_id)""")
REPLACEMENT = "SELECT symbol, from_bar, high_id, low_id, replaced_at FROM replaced"

#: Broken levels with their price and the bar from which another level of that side is in force.
BROKEN = ("broken", """
SELECT k.symbol, k.level_id, k.side, k.bar, CASE WHEN k.side = 1 THEN l.high_level ELSE l.low_level END AS level, r.until_bar FROM breaks k JOIN levels l ON l.symbol = k.symbol AND l.bar = k.bar
LEFT JOIN (SELECT symbol, side, id, lead(since) OVER (PARTITION BY symbol, side ORDER BY since) AS until_bar FROM (
    SELECT symbol, 1 AS side, high_id AS id, min(bar) AS since FROM levels WHERE high_id IS NOT NULL GROUP BY symbol, high_id
    UNION ALL SELECT symbol, -1, low_id, min(bar) FROM levels WHERE low_id IS NOT NULL GROUP BY symbol, low_id)) r ON r.symbol = k.symbol AND r.side = k.side AND r.id = k.level_id""")

INFORCE = ("inforce", """
SELECT symbol, bar, 1 AS side, high_id AS level_id FROM levels WHERE high_id IS NOT NULL UNION ALL SELECT symbol, bar, -1, low_id FROM levels WHERE low_id IS NOT NULL""")


_FLAGS = """side = 1 AND low_u <= level OR side = -1 AND high_u >= level AS inside_f, side = 1 AND close_u > level OR side = -1 AND close_u < level AS beyond_f"""
#: Each bar of a level in force: whether it reaches back inside and closes beyond, and the next bars of its level that do. One
#: ordered pass over a level's bars answers what every event on that level asks, by the bar that it asks from.
INSIDE = ("inside", (f"""
SELECT symbol, side, level_id, bar, inside_f, beyond_f, min(CASE WHEN inside_f THEN bar END) OVER d AS next_inside, min(CASE WHEN inside_f AND beyond_f THEN bar END) OVER d AS next_both,
       min(CASE WHEN beyond_f THEN bar END) OVER (PARTITION BY symbol, side, level_id ORDER BY bar DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS beyond_from
FROM (SELECT symbol, side, level_id, bar, {_FLAGS} FROM (
  SELECT l.symbol, v.side, l.bar, b.low_u, b.high_u, b.close_u, CASE v.side WHEN 1 THEN l.high_id ELSE l.low_id END AS level_id, CASE v.side WHEN 1 THEN l.high_level ELSE l.low_level END AS level
  FROM levels l JOIN nb b ON b.symbol = l.symbol AND b.bar = l.bar CROSS JOIN (VALUES (1), (-1)) AS v(side)) WHERE level_id IS NOT NULL)
WINDOW d AS (PARTITION BY symbol, side, level_id ORDER BY bar DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", None))
_AT = "i.symbol = k.symbol AND i.side = k.side AND i.level_id = k.level_id AND i.bar"


def _meet(source: str) -> str:
    """For checking: all bars after those of ``source`` before their level is replaced, by a range over all later bars."""
    return f"""SELECT k.symbol, k.level_id, k.side, k.bar, k.level, b.bar AS at_bar, k.side = 1 AND b.low_u <= k.level OR k.side = -1 AND b.high_u >= k.level AS inside_f,
       k.side = 1 AND b.close_u > k.level OR k.side = -1 AND b.close_u < k.level AS beyond_f, k.opposite_bar IS NULL OR b.bar < k.opposite_bar AS open_f
FROM {source} k JOIN nb b ON b.symbol = k.symbol AND b.bar > k.bar AND (k.until_bar IS NULL OR b.bar < k.until_bar)"""


def _opposed(name: str, source: str) -> tuple[str, tuple[str, str]]:
    """Events with the first later bar that has one of the other side, which cancels a wait: seen from the last event backwards."""
    pick = "CASE WHEN side = 1 THEN min(CASE WHEN side = -1 THEN bar END) OVER f ELSE min(CASE WHEN side = 1 THEN bar END) OVER f END AS opposite_bar"
    cols = f"SELECT symbol, level_id, side, bar, level, until_bar, {pick} FROM {source} WINDOW f AS (PARTITION BY symbol ORDER BY bar"
    return name, (f"{cols} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"{cols} RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")


OPPOSED = _opposed("opposed", "broken")
AFTERWARDS = ("afterwards", (None, _meet("opposed")))
_OPEN = "(k.opposite_bar IS NULL OR i.{0} < k.opposite_bar)"

#: First later bar before replacement whose extreme is back inside; then its first executable tick there.
RETURNED = ("returned", (
    f"SELECT k.symbol, k.level_id, k.side, k.bar, k.level, i.next_inside AS return_bar FROM opposed k JOIN inside i ON {_AT} = k.bar WHERE i.next_inside IS NOT NULL",
    "SELECT symbol, level_id, side, bar, level, min(at_bar) AS return_bar FROM afterwards WHERE inside_f GROUP BY symbol, level_id, side, bar, level",
))
FIRST_RETURN = """
SELECT r.symbol, r.level_id, r.side, r.bar, r.return_bar, min(t.seq) AS return_seq FROM returned r JOIN nb b ON b.symbol = r.symbol AND b.bar = r.return_bar
LEFT JOIN ticks t ON t.symbol = b.symbol AND t.session_day = b.session_day AND t.ts_ns ~div~ 3600000000000 = b.bucket AND t.ask_u > t.bid_u AND (r.side = 1 AND t.bid_u <= r.level OR r.side = -1 AND t.bid_u >= r.level)
GROUP BY r.symbol, r.level_id, r.side, r.bar, r.return_bar"""

#: First later bar that touches the level and closes back beyond it, before replacement and before a break of the other side.
RECLAIMED = ("reclaimed", (
    f"SELECT k.symbol, k.level_id, k.side, k.bar, k.level, i.next_both AS reclaim_bar FROM opposed k JOIN inside i ON {_AT} = k.bar WHERE i.next_both IS NOT NULL AND {_OPEN.format('next_both')}",
    "SELECT symbol, level_id, side, bar, min(at_bar) AS reclaim_bar FROM afterwards WHERE open_f AND inside_f AND beyond_f GROUP BY symbol, level_id, side, bar",
))
CLOSE_RECLAIM = "SELECT symbol, level_id, side, bar, reclaim_bar FROM reclaimed"

#: First bar that touches the level again, then the first from there that closes beyond it; cancelled likewise.
TOUCHED = ("touched", (
    f"SELECT k.symbol, k.level_id, k.side, k.bar, k.opposite_bar, i.next_inside AS touch_bar FROM opposed k JOIN inside i ON {_AT} = k.bar WHERE i.next_inside IS NOT NULL AND {_OPEN.format('next_inside')}",
    "SELECT symbol, level_id, side, bar, min(at_bar) AS touch_bar FROM afterwards WHERE open_f AND inside_f GROUP BY symbol, level_id, side, bar",
))
TOUCH_RECLAIM = (
    f"SELECT k.symbol, k.level_id, k.side, k.bar, k.touch_bar, CASE WHEN {_OPEN.format('beyond_from')} THEN i.beyond_from END AS reclaim_bar FROM touched k JOIN inside i ON {_AT} = k.touch_bar",
    """
SELECT t.symbol, t.level_id, t.side, t.bar, t.touch_bar, min(CASE WHEN a.open_f AND a.beyond_f THEN a.at_bar END) AS reclaim_bar
FROM touched t JOIN afterwards a ON a.symbol = t.symbol AND a.side = t.side AND a.level_id = t.level_id AND a.bar = t.bar AND a.at_bar >= t.touch_bar GROUP BY t.symbol, t.level_id, t.side, t.bar, t.touch_bar""",
)

#: Every close across a level in force, not only the first; what a retest rule reads of each, within ``WINDOW`` bars.
WINDOW = 5
CROSSED = ("crossed", """
SELECT c.symbol, c.side, c.level_id, c.bar, c.level, u.until_bar FROM (
  SELECT symbol, 1 AS side, high_id AS level_id, bar, high_level AS level FROM levels WHERE prev_close <= high_level AND close_u > high_level
  UNION ALL SELECT symbol, -1, low_id, bar, low_level FROM levels WHERE prev_close >= low_level AND close_u < low_level) c
JOIN (SELECT symbol, side, level_id, lead(since) OVER (PARTITION BY symbol, side ORDER BY since) AS until_bar FROM (SELECT symbol, side, level_id, min(bar) AS since FROM inforce GROUP BY symbol, side, level_id)) u
ON u.symbol = c.symbol AND u.side = c.side AND u.level_id = c.level_id""")
CROSS_OPPOSED = _opposed("cross_opposed", "crossed")
LATER = ("later", (None, _meet("cross_opposed")))
#: The few bars after each bar of a level, by where they are asked from.
SOON = ("soon", (f"SELECT symbol, side, level_id, bar - k AS from_bar, bar AS at_bar, inside_f, beyond_f FROM inside CROSS JOIN (SELECT SERIES(1, {WINDOW - 1}) AS k) s", None))
_SAME = "a.symbol = f.symbol AND a.side = f.side AND a.level_id = f.level_id"
_FEW = f"soon a ON {_SAME} AND a.from_bar = f.bar AND (f.opposite_bar IS NULL OR a.at_bar < f.opposite_bar)"
_ALL = f"later a ON {_SAME} AND a.bar = f.bar AND a.at_bar < f.bar + {WINDOW} AND a.open_f"
FINALS = ("finals", tuple(f"""
SELECT f.symbol, f.side, f.level_id, f.bar, f.until_bar, f.opposite_bar, min(CASE WHEN a.inside_f THEN a.at_bar END) AS touch_bar, min(CASE WHEN a.inside_f AND a.beyond_f THEN a.at_bar END) AS close_bar
FROM cross_opposed f LEFT JOIN {later} GROUP BY f.symbol, f.side, f.level_id, f.bar, f.until_bar, f.opposite_bar""" for later in (_FEW, _ALL)))
SETTLED = ("settled", tuple(f"""
SELECT f.symbol, f.side, f.level_id, f.bar, f.until_bar, f.opposite_bar, f.close_bar, min(a.at_bar) AS touch_bar
FROM finals f LEFT JOIN {later} AND a.beyond_f AND a.at_bar >= f.touch_bar
GROUP BY f.symbol, f.side, f.level_id, f.bar, f.until_bar, f.opposite_bar, f.close_bar""" for later in (_FEW, _ALL)))
CARRIER = (
    f"""
SELECT f.symbol, f.side, f.level_id, f.bar, f.until_bar, f.opposite_bar, f.touch_bar, f.close_bar, a.next_inside AS return_bar, b.next_inside AS return_touch, c.next_inside AS return_close
FROM settled f LEFT JOIN inside a ON {_SAME} AND a.bar = f.bar LEFT JOIN inside b ON {_SAME.replace('a.', 'b.')} AND b.bar = f.touch_bar LEFT JOIN inside c ON {_SAME.replace('a.', 'c.')} AND c.bar = f.close_bar""",
    f"""
SELECT f.symbol, f.side, f.level_id, f.bar, f.until_bar, f.opposite_bar, f.touch_bar, f.close_bar, min(CASE WHEN a.inside_f THEN a.at_bar END) AS return_bar,
       min(CASE WHEN a.inside_f AND a.at_bar > f.touch_bar THEN a.at_bar END) AS return_touch, min(CASE WHEN a.inside_f AND a.at_bar > f.close_bar THEN a.at_bar END) AS return_close
FROM settled f LEFT JOIN later a ON {_SAME} AND a.bar = f.bar GROUP BY f.symbol, f.side, f.level_id, f.bar, f.until_bar, f.opposite_bar, f.touch_bar, f.close_bar""",
)

#: The retest rules as a recursion over a side's crosses, for checking: the level that signalled last, from when it may again, and
#: until when a cross that waited in vain blocks others.
RETEST_SQL = f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY bar, level_id) AS n FROM ({{0}})),
s AS (SELECT * FROM (VALUES ('return'), ('replaced'), ('once')) AS a(rearm) CROSS JOIN (VALUES ('off'), ('touch'), ('close')) AS b(retest)),
r AS (SELECT DISTINCT c.symbol, c.side, s.rearm, s.retest, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS bar, CAST(NULL AS BIGINT) AS signal_bar, CAST(NULL AS BIGINT) AS used, CAST(-1 AS BIGINT) AS allowed, CAST(-1 AS BIGINT) AS blocked, FALSE AS fired FROM c CROSS JOIN s
 UNION ALL SELECT symbol, side, rearm, retest, n, bar, final, CASE WHEN fires THEN level_id ELSE used END, CASE WHEN fires THEN coalesce(least(back, until_bar), 9223372036854775807) ELSE allowed END,
   CASE WHEN fires THEN -1 WHEN passes THEN least(until_bar, opposite_bar, bar + {WINDOW}) ELSE blocked END, fires FROM (SELECT *, passes AND final IS NOT NULL AS fires FROM (
   SELECT c.symbol, c.side, r.rearm, r.retest, c.n, c.bar, c.level_id, c.until_bar, c.opposite_bar, r.used, r.allowed, r.blocked,
     NOT (c.bar < r.blocked OR coalesce(c.level_id = r.used, FALSE) AND (r.rearm <> 'return' OR c.bar < r.allowed)) AS passes,
     CASE r.retest WHEN 'off' THEN c.bar WHEN 'touch' THEN c.touch_bar ELSE c.close_bar END AS final, CASE r.retest WHEN 'off' THEN c.return_bar WHEN 'touch' THEN c.return_touch ELSE c.return_close END AS back
   FROM r JOIN c ON c.symbol = r.symbol AND c.side = r.side AND c.n = r.n + 1)))
SELECT symbol, side, rearm, retest, used AS level_id, bar, signal_bar FROM r WHERE fired"""

#: Identity of an event: the digest of its canonical text, names in order.
EVENT_IDS = """
SELECT symbol, bar, SHA(body) AS event_id FROM (SELECT symbol, bar, '{"bar":' || CAST(bar AS VARCHAR(20)) || ',"level":' || CAST(level_id AS VARCHAR(20)) || ',"side":' || CAST(side AS VARCHAR(20)) || ',"symbol":"' || symbol || '"}' AS body FROM breaks)"""

#: Per bar: the last four distinct boxes' widths, and the middle of the box in force.
BOX_STATE = ("box_state", """
SELECT s.symbol, s.bar, s.close_u, (s.high_level + s.low_level) / 2.0 AS middle, b.width, b.width1, b.width2, b.width3 FROM (
  SELECT symbol, bar, close_u, high_level, low_level, sum(changed) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS box FROM box_marks) s
JOIN (SELECT symbol, row_number() OVER w AS box, high_level - low_level AS width, lag(high_level - low_level, 1) OVER w AS width1, lag(high_level - low_level, 2) OVER w AS width2, lag(high_level - low_level, 3) OVER w AS width3
  FROM box_marks WHERE changed = 1 WINDOW w AS (PARTITION BY symbol ORDER BY bar)) b ON b.symbol = s.symbol AND b.box = s.box""")
BOX_MARKS = ("box_marks", """
SELECT symbol, bar, close_u, high_level, low_level, CASE WHEN h0 IS NULL OR l0 IS NULL OR h0 <> high_id OR l0 <> low_id THEN 1 ELSE 0 END AS changed FROM (
  SELECT symbol, bar, close_u, high_level, low_level, high_id, low_id, lag(high_id) OVER w AS h0, lag(low_id) OVER w AS l0 FROM levels WINDOW w AS (PARTITION BY symbol ORDER BY bar))
WHERE high_id IS NOT NULL AND low_id IS NOT NULL""")
