"""Queries of the document pipeline's driver and segments, sources, sinks, provider calls and the remaining scalars."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import docs as dc
from lorespark.operators import driver, refine, schema, segment, sketch, store, tree
from lorespark.operators import provider as pv
from lorespark.operators import retrieval as rt
from lorespark.plans import relational as rel
from lorespark.plans.knowledge import MARKDOWN, _parts
from lorespark.plans.retrieving import KB, KC, KQ, OUTLINE, RESTRICTED, _choices, _questions, _store
from lorespark.sources import config, convert, files, prompts, snapshot, versions
from lorespark.sources.shared import file_system, new_folder, stored

_OWN: list[str] = []


def query(name: str, names: tuple[str, ...], sql: str | None):
    _OWN.append(name)
    return rel.query(name, names, sql)


# --- sections and segments -------------------------------------------------------------------------

TWINS = "tw AS (SELECT source_id, line_start, least(line_end + (line_start % 3) * 4, total_lines) AS line_end, level, 'part ' || (row_number() OVER (PARTITION BY source_id ORDER BY line_start)) // 3 AS title, row_number() OVER (PARTITION BY source_id ORDER BY line_start) AS n FROM ol JOIN tot USING (source_id))"


@query("WIN09_merge_overlaps", ("sources",), f"""WITH RECURSIVE {MARKDOWN}, {TWINS}, f AS (SELECT source_id, n, 1 AS part, line_start, line_end, level, title FROM tw WHERE n = 1 UNION ALL
    SELECT t.source_id, t.n, CASE WHEN t.line_start <= f.line_end AND t.title = f.title THEN f.part ELSE f.part + 1 END, CASE WHEN t.line_start <= f.line_end AND t.title = f.title THEN f.line_start ELSE t.line_start END,
        CASE WHEN t.line_start <= f.line_end AND t.title = f.title THEN greatest(f.line_end, t.line_end) ELSE t.line_end END, CASE WHEN t.line_start <= f.line_end AND t.title = f.title THEN f.level ELSE t.level END, t.title
    FROM f JOIN tw t ON t.source_id = f.source_id AND t.n = f.n + 1) SELECT source_id, line_start, max(line_end) AS line_end, any_value(level) AS level, any_value(title) AS title FROM f GROUP BY source_id, part, line_start""")
def _(s):
    from pyspark.sql import Window as W

    _, totals, nodes = _parts(s)
    n = F.row_number().over(W.partitionBy("source_id").orderBy("line_start"))
    twins = nodes.join(totals, "source_id").select("source_id", "line_start", F.least(F.col("line_end") + (F.col("line_start") % 3) * 4, F.col("total_lines")).alias("line_end"), "level", F.concat(F.lit("part "), F.floor(n / 3).cast("string")).alias("title"))
    return refine.merge_overlaps(twins, ["source_id"]).select("source_id", "line_start", "line_end", "level", "title")


CUM = "cu0 AS (SELECT source_id, line_no, sum(length(line) + 1) OVER (PARTITION BY source_id ORDER BY line_no) AS until FROM md)"


def merged(raw: str, least: int) -> str:
    """CTEs that end in ``mg``: the segments of ``raw`` (source_id, line_start, line_end, title) with small ones merged."""
    small = f"(f.until - f.before - 1 < {least})"
    return f"""sg AS (SELECT r.*, row_number() OVER (PARTITION BY r.source_id ORDER BY r.line_start) AS n, coalesce(a.until, 0) AS before, b.until FROM ({raw}) r LEFT JOIN cu0 a ON a.source_id = r.source_id AND a.line_no = r.line_start - 1 JOIN cu0 b ON b.source_id = r.source_id AND b.line_no = r.line_end),
    f AS (SELECT source_id, n, 1 AS part, line_start, line_end, title, before, until FROM sg WHERE n = 1 UNION ALL
        SELECT x.source_id, x.n, CASE WHEN {small} THEN f.part ELSE f.part + 1 END, CASE WHEN {small} THEN f.line_start ELSE x.line_start END, x.line_end, CASE WHEN {small} AND f.title <> '' THEN f.title ELSE x.title END, CASE WHEN {small} THEN f.before ELSE x.before END, x.until
        FROM f JOIN sg x ON x.source_id = f.source_id AND x.n = f.n + 1),
    fw AS (SELECT source_id, part, max(line_start) AS line_start, max(line_end) AS line_end, arg_max(title, n) AS title, max(before) AS before, max(until) AS until FROM f GROUP BY 1, 2),
    fl AS (SELECT *, max(part) OVER (PARTITION BY source_id) AS parts, max(line_end) OVER (PARTITION BY source_id) AS last_end FROM fw),
    fs AS (SELECT *, max(CASE WHEN part = parts AND parts > 1 AND until - before - 1 < {least} THEN 1 ELSE 0 END) OVER (PARTITION BY source_id) AS back FROM fl),
    mg AS (SELECT source_id, line_start, CASE WHEN back = 1 AND part = parts - 1 THEN last_end ELSE line_end END AS line_end, title FROM fs WHERE NOT (back = 1 AND part = parts))"""


DEEPEST = "SELECT g.source_id, g.line_start, g.line_end, g.title, arg_max(o.line_start, (o.level, -o.line_start)) AS outline_line FROM mg g LEFT JOIN ol o ON o.source_id = g.source_id AND o.line_start <= g.line_start AND o.line_end >= g.line_end GROUP BY ALL"


@query("WIN14_merge_small", ("sources",), f"WITH RECURSIVE {MARKDOWN}, {CUM}, {merged('SELECT source_id, line_start, line_end, title FROM ol', 300)} {DEEPEST}")
def _(s):
    md, _, nodes = _parts(s)
    parts = dc.merge_small(dc.sized(nodes.select("source_id", "line_start", "line_end", "title"), md), 300)
    return driver.matched(parts, nodes)


LEAF = "SELECT a.source_id, a.line_start, a.line_end, a.title FROM ol a WHERE NOT EXISTS (SELECT 1 FROM ol b WHERE b.source_id = a.source_id AND b.parent_line = a.line_start) AND a.title NOT IN ('toc')"


@query("DOC10_segments", ("sources",), f"WITH RECURSIVE {MARKDOWN}, {CUM}, {merged(LEAF, 400)} {DEEPEST}")
def _(s):
    md, _, nodes = _parts(s)
    return driver.segments(nodes, md, 400)


@query("SRT10_segments_in_order", ("sources",), f"WITH RECURSIVE {MARKDOWN}, {CUM}, {merged(LEAF, 400)} SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY line_start) AS place, line_start FROM mg")
def _(s):
    from pyspark.sql import Window as W

    md, _, nodes = _parts(s)
    return driver.segments(nodes, md, 400).select("source_id", F.row_number().over(W.partitionBy("source_id").orderBy("line_start")).cast("bigint").alias("place"), "line_start")


NODE_TOKENS = "nt AS (SELECT a.source_id, a.line_start, row_number() OVER (PARTITION BY a.source_id ORDER BY a.line_start) AS n, greatest(floor((length(a.title) + length(array_to_string(list_slice(string_split(s.text, chr(10)), a.line_start, a.line_end), chr(10)))) / 1.5), 10)::BIGINT AS tokens FROM ol a JOIN sources s USING (source_id))"


@query("WIN15_token_batches", ("sources",), f"""WITH RECURSIVE {MARKDOWN}, {NODE_TOKENS}, f AS (SELECT source_id, n, line_start, 0::BIGINT AS batch, tokens AS held FROM nt WHERE n = 1 UNION ALL
    SELECT x.source_id, x.n, x.line_start, CASE WHEN f.held + x.tokens > 700 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.held + x.tokens > 700 THEN x.tokens ELSE f.held + x.tokens END FROM f JOIN nt x ON x.source_id = f.source_id AND x.n = f.n + 1)
    SELECT source_id, line_start, batch FROM f""")
def _(s):
    nodes = _parts(s)[2].join(s.select("source_id", "text"), "source_id")
    body = tx.line_range(F.col("text"), F.col("line_start").cast("int"), F.col("line_end").cast("int"))
    return dc.greedy_batches(nodes.select("source_id", "line_start", tx.token_estimate(F.concat("title", body)).alias("tokens")), 700)


@query("FLT16_contents", ("sources",), """SELECT source_id, source_id % 5 = 0 OR (n > 0 AND links / n > 0.7) AS contents FROM (SELECT source_id, len(list_filter(l, lambda x: x <> '')) AS n, len(list_filter(l, lambda x: starts_with(x, '- [') AND contains(x, '](#'))) AS links
    FROM (SELECT source_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN trim(x) = '' THEN '' WHEN source_id % 3 = 0 OR i % 4 <> source_id % 4 THEN '- [' || trim(x) || '](#a)' ELSE trim(x) END) AS l FROM sources))""")
def _(s):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(F.trim(x) == "", F.lit(" ")).when((F.col("source_id") % 3 == 0) | ((i + 1) % 4 != F.col("source_id") % 4), F.concat(F.lit("- ["), F.trim(x), F.lit("](#a)"))).otherwise(x))
    return s.select("source_id", dc.is_contents(F.when(F.col("source_id") % 5 == 0, "TOC").otherwise("Other"), F.array_join(lines, "\n")).alias("contents"))


def _tree_level(level: int) -> str:
    below = " UNION ALL ".join(f"SELECT source_id, parent_line, line_start, json FROM j{k}" for k in range(level + 1, 5)) or "SELECT NULL::BIGINT AS source_id, NULL::BIGINT AS parent_line, NULL::BIGINT AS line_start, '' AS json WHERE false"
    return f"""j{level} AS (SELECT n.source_id, n.parent_line, n.line_start, '{{"title":' || to_json(n.title) || ',"line":' || n.line_start || ',"children":[' || coalesce(k.kids, '') || ']}}' AS json FROM ol n
        LEFT JOIN (SELECT source_id, parent_line, string_agg(json, ',' ORDER BY line_start) AS kids FROM ({below}) GROUP BY 1, 2) k ON k.source_id = n.source_id AND k.parent_line = n.line_start WHERE n.level = {level})"""


_EVERY = " UNION ALL ".join(f"SELECT * FROM j{k}" for k in range(1, 5))


@query("DOC14_tree", ("sources",), f"WITH {MARKDOWN}, {', '.join(_tree_level(k) for k in (4, 3, 2, 1))} SELECT source_id, '[' || string_agg(json, ',' ORDER BY line_start) || ']' AS tree FROM ({_EVERY}) WHERE parent_line IS NULL GROUP BY 1")
def _(s):
    return tree.nested(_parts(s)[2])


# --- windows ---------------------------------------------------------------------------------------------


def windows(name: str, texts: str, most: int) -> str:
    """CTEs that end in ``name``: key, a and b, the lines (from 1) of each window of the texts (key, text)."""
    bound = f"(CASE WHEN s = 0 THEN 0 ELSE c[s] END) + {most}"
    first = "greatest(e - greatest(10, (e - s) // 5), s + 1)"
    broken = f"SELECT key, s, c, rk, CASE WHEN e >= len(c) THEN e WHEN coalesce(best, 0) // 1000000 > 0 THEN best % 1000000 ELSE e END AS e FROM (SELECT *, list_max(list_transform(range({first}, e), lambda i: rk[i + 1] * 1000000 + i)) AS best FROM (SELECT *, greatest(s + 1, len(list_filter(c, lambda x: x <= {bound}))) AS e FROM ({{}})))"
    after = "SELECT key, CASE WHEN e - s <= 10 THEN e WHEN e - greatest(5, floor((e - s) * 0.05)::BIGINT) > s THEN e - greatest(5, floor((e - s) * 0.05)::BIGINT) ELSE e END AS s, c, rk FROM {n}_w WHERE e < len(c)".format(n=name)
    return rf"""{name}_l AS (SELECT key, i, l[i] AS line FROM (SELECT key, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT key, string_split(text, chr(10)) AS l FROM ({texts})))),
    {name}_p AS (SELECT *, starts_with(trim(line), '```') AS fe, sum(starts_with(trim(line), '```')::INT) OVER w AS fs, sum(length(line) + 1) OVER w AS cum FROM {name}_l WINDOW w AS (PARTITION BY key ORDER BY i)),
    {name}_a AS (SELECT key, list(cum ORDER BY i) AS c, list((CASE WHEN fe OR fs % 2 = 1 OR starts_with(trim(line), '|') THEN 0 WHEN regexp_matches(line, '^#{{1,6}}\s+\S') THEN 3 WHEN trim(line) = '' THEN 2 ELSE 1 END)::BIGINT ORDER BY i) AS rk FROM {name}_p GROUP BY key),
    {name}_w AS ({broken.format(f'SELECT key, 0::BIGINT AS s, c, rk FROM {name}_a')} UNION ALL {broken.format(after)}),
    {name} AS (SELECT key, s + 1 AS a, e AS b FROM {name}_w)"""


PLAIN = "vp AS (SELECT source_id AS key, string_agg(line, chr(10) ORDER BY line_no) AS text FROM md GROUP BY 1)"


def _plain(s: DataFrame) -> DataFrame:
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i == 0, "# ").when((i + 1) % 13 == 5, "```").when((i + 1) % 10 == 0, "## ").when((i + 1) % 4 == 0, "##### ").otherwise(""), x))
    return s.select("source_id", F.array_join(marked, "\n").alias("text"))


@query("WIN13_windows", ("sources",), f"WITH RECURSIVE {MARKDOWN}, {PLAIN}, {windows('w', 'SELECT * FROM vp', 700)} SELECT key AS source_id, a AS line_start, b AS line_end FROM w")
def _(s):
    return dc.windows(_plain(s), 700)


@query("DOC04_sections", ("sources",), f"""WITH RECURSIVE {MARKDOWN}, {PLAIN}, {windows('w', 'SELECT * FROM vp WHERE length(text) > 1200', 1200)}, st AS (SELECT DISTINCT key AS source_id, a FROM w UNION SELECT key, 1 FROM vp WHERE length(text) <= 1200)
    SELECT st.source_id, CASE WHEN trim(m.line) = '' THEN 'untitled' ELSE left(trim(m.line), 30) END AS title, a AS line_start, coalesce(lead(a) OVER (PARTITION BY st.source_id ORDER BY a) - 1, total_lines) AS line_end, 1 AS level FROM st JOIN md m ON m.source_id = st.source_id AND m.line_no = a JOIN tot ON tot.source_id = st.source_id""")
def _(s):
    """Long texts by windows; the provider can't merge sketches, so rules do."""
    return sketch.sections(_plain(s), pv.first_lines, 800)


HEADED = "hp AS (SELECT source_id, i::BIGINT AS line_no, CASE WHEN i % 5 = 1 THEN '# head ' || i::VARCHAR || ' ' ELSE '- ' END || l[i] AS line FROM (SELECT source_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source_id, string_split(text, chr(10)) AS l FROM sources)))"


@query("DOC04_merged_sketches", ("sources",), f"""WITH {HEADED}, ln AS (SELECT source_id, max(line_no) AS total, sum(length(line) + 1) - 1 AS chars FROM hp GROUP BY 1)
    SELECT source_id, trim(line, '# ') AS title, line_no AS line_start, coalesce(lead(line_no) OVER (PARTITION BY source_id ORDER BY line_no) - 1, total) AS line_end, 1 AS level FROM hp JOIN ln USING (source_id) WHERE line_no % 5 = 1""")
def _(s):
    """Sketches of small windows, merged in several rounds: each section comes out once, as if the whole text had been read at once."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 5 == 0, F.concat(F.lit("# head "), (i + 1).cast("string"), F.lit(" "))).otherwise("- "), x))
    docs = s.select("source_id", F.array_join(marked, "\n").alias("text"))
    return sketch.sections(docs, pv.sections_of_headings, 300).withColumn("title", F.trim("title", F.lit("# ")))


def _body(text: str) -> str:
    return f"array_to_string(list_slice(string_split({text}, chr(10)), a.line_start, a.line_end), chr(10))"


def refined(first: str, texts: str, steps: tuple[int, int], most: int) -> str:
    """CTEs that end in ``rn``: the nodes that refinement adds to the leaves ``first`` (source_id, line_start, line_end, level), with sections of
    ``steps`` lines for levels 2 and 3 where a model answers (not for every fourth length); ``texts`` has source_id and text."""

    def kids(front: str) -> str:
        step = f"CASE level WHEN 1 THEN {steps[0]} ELSE {steps[1]} END"
        return f"SELECT source_id, s AS line_start, least(s + {step} - 1, line_end) AS line_end, level + 1 AS level, 'part ' || s AS title, line_start AS parent_line, level AS parent_level FROM (SELECT *, unnest(range(line_start, line_end + 1, {step})) AS s FROM {front} WHERE level < 3 AND length(text) % 4 <> 0)"

    def front(nodes: str) -> str:
        return f"SELECT * FROM (SELECT a.*, {_body('t.text')} AS text FROM ({nodes}) a JOIN ({texts}) t USING (source_id)) WHERE length(text) > {most}"

    replaced = "NOT EXISTS (SELECT 1 FROM deep d WHERE d.source_id = k.source_id AND d.line_start = k.line_start AND k.level = 3)"
    return f"""f1 AS ({front(first)}), k1 AS ({kids('f1')}), f2 AS ({front('SELECT * FROM k1')}), k2 AS ({kids('f2')}), f3 AS ({front('SELECT * FROM k2')}),
    deep AS (SELECT *, source_id * 100000 + line_start AS key FROM (SELECT * FROM f2 WHERE level = 3 UNION ALL SELECT * FROM f3)), {windows('rw', 'SELECT key, text FROM deep', most)},
    rn AS (SELECT k.* FROM k1 k WHERE {replaced} UNION ALL SELECT k.* FROM k2 k WHERE {replaced} UNION ALL
        SELECT source_id, line_start + a - 1, line_start + b - 1, level, CASE WHEN n = 1 THEN title ELSE title || '（' || i || '/' || n || '）' END, parent_line, parent_level
        FROM deep JOIN (SELECT key, a, b, row_number() OVER (PARTITION BY key ORDER BY a) AS i, count(*) OVER (PARTITION BY key) AS n FROM rw) USING (key))"""


def lines_now_and_then(steps: tuple[int, int]):
    """Sections of ``steps`` lines for levels 2 and 3; no reply for texts of every fourth length."""

    def call(request: str) -> str:
        if len(json.loads(request)["text"]) % 4 == 0:
            raise OSError
        return pv.sections_of_lines(request, {2: steps[0], 3: steps[1]})

    return call


PLACE = "row_number() OVER (PARTITION BY source_id, parent_line, parent_level ORDER BY line_start, level, title) - 1 AS position"


@query("DOC06_refined", ("sources",), f"""WITH RECURSIVE {MARKDOWN}, {PLAIN}, {refined('SELECT source_id, 1::BIGINT AS line_start, total_lines AS line_end, 1::BIGINT AS level FROM tot', 'SELECT key AS source_id, text FROM vp', (4, 2), 300)}
    SELECT *, {PLACE} FROM (SELECT source_id, 1 AS line_start, total_lines AS line_end, 1 AS level, 'all' AS title, NULL AS parent_line, NULL AS parent_level, 'structural' AS node_type FROM tot UNION ALL SELECT *, 'semantic' FROM rn)""")
def _(s):
    """From one node for the whole text, three levels down, and by windows where that doesn't do."""
    md, totals, _ = _parts(s)
    none = F.lit(None).cast("bigint")
    one = totals.select("source_id", F.lit(1).cast("bigint").alias("line_start"), F.col("total_lines").alias("line_end"), F.lit(1).cast("bigint").alias("level"), F.lit("all").alias("title"), none.alias("parent_line"), none.alias("parent_level"), F.lit("structural").alias("node_type"))
    return refine.refine(one, md, lines_now_and_then((4, 2)), 300, 1 << 30)


LONG = "lx AS (SELECT a.source_id, a.line_start, a.title, array_to_string(list_slice(string_split(s.text, chr(10)), a.line_start, a.line_end), chr(10)) AS text, a.source_id * 100000 + a.line_start AS key FROM ol a JOIN sources s USING (source_id) WHERE NOT EXISTS (SELECT 1 FROM ol b WHERE b.source_id = a.source_id AND b.parent_line = a.line_start))"


@query("DOC06_split_leaves", ("sources",), f"""WITH RECURSIVE {MARKDOWN}, {LONG}, {windows('w', 'SELECT key, text FROM lx WHERE length(text) > 400', 400)}, nw AS (SELECT key, a, row_number() OVER (PARTITION BY key ORDER BY a) AS i, count(*) OVER (PARTITION BY key) AS n FROM w)
    SELECT source_id, line_start, title FROM lx WHERE length(text) <= 400 UNION ALL SELECT source_id, line_start + a - 1, CASE WHEN n = 1 THEN title ELSE title || '（' || i || '/' || n || '）' END FROM lx JOIN nw USING (key)""")
def _(s):
    """The rule by which leaves are divided where no model does."""
    leaf = stored(refine.bodies(tree.leaves(_parts(s)[2]), dc.lines(s)), "leaves")
    long = F.char_length("text") > 400
    return leaf.filter(~long).select("source_id", "line_start", "title").unionByName(refine.by_windows(leaf.filter(long), 400).select("source_id", "line_start", "title"))


# --- the driver --------------------------------------------------------------------------------------

VIEW = "vw AS (SELECT source_id, CASE WHEN source_id % 50 = 7 THEN NULL ELSE string_agg(line, chr(10) ORDER BY line_no) END AS text FROM md GROUP BY 1)"
REASONS = """n AS (SELECT source_id, count(*) AS n, sum(line_end - line_start + 1) AS covered, min(level) = max(level) AS flat FROM ol GROUP BY 1),
    lf AS (SELECT a.source_id, max((SELECT length(array_to_string(list_slice(string_split(v.text, chr(10)), a.line_start, a.line_end), chr(10))))) AS longest FROM ol a JOIN vw v USING (source_id)
        WHERE NOT EXISTS (SELECT 1 FROM ol b WHERE b.source_id = a.source_id AND b.parent_line = a.line_start) GROUP BY 1),
    rs AS (SELECT source_id, text, CASE WHEN n IS NULL THEN 'A' ELSE '' END || CASE WHEN n < 3 AND length(text) > 2000 THEN 'B' ELSE '' END || CASE WHEN covered / len(string_split(text, chr(10))) < 0.5 THEN 'C' ELSE '' END
        || CASE WHEN n < 5 AND flat THEN 'D' ELSE '' END || CASE WHEN longest > 600 THEN 'E' ELSE '' END AS reasons FROM vw LEFT JOIN n USING (source_id) LEFT JOIN lf USING (source_id))"""
MIXED = refined("SELECT o.source_id, o.line_start, o.line_end, o.level FROM ol o JOIN rs USING (source_id) WHERE reasons = 'E' AND o.level < 3 AND NOT EXISTS (SELECT 1 FROM ol b WHERE b.source_id = o.source_id AND b.parent_line = o.line_start)", "SELECT source_id, text FROM vw", (3, 2), 600)
TYPED = "ty AS (SELECT *, CASE WHEN reasons = 'E' AND EXISTS (SELECT 1 FROM rn WHERE rn.source_id = rs.source_id) THEN 'mixed' WHEN reasons NOT IN ('', 'E') AND length(text) % 4 <> 0 THEN 'semantic' ELSE 'structural' END AS outline_type FROM rs WHERE text IS NOT NULL)"


def now_and_then(request: str) -> str:
    """One section for a whole text, some lines of a node that is refined; no reply for some texts."""
    if "level" in json.loads(request):
        return lines_now_and_then((3, 2))(request)
    if len(json.loads(request)["text"]) % 4 == 0:
        raise OSError
    return pv.first_lines(request)


def _view(s: DataFrame) -> DataFrame:
    n = lambda i: i + 1
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(n(i) == 1, "# ").when(n(i) % 13 == 5, "```").when(n(i) % 10 == 0, "## ").when(n(i) % 4 == 0, "##### ").otherwise(""), x))
    return s.select("source_id", F.when(F.col("source_id") % 50 != 7, F.array_join(marked, "\n")).alias("text"))


def _processed(s: DataFrame) -> driver.Processed:
    return driver.process(_view(s), now_and_then, 600, 1 << 30)


@query("DOC02_process", ("sources",), f"WITH RECURSIVE {MARKDOWN}, {VIEW}, {REASONS}, {MIXED}, {TYPED} SELECT v.source_id, CASE WHEN v.text IS NULL THEN 'failed' ELSE 'completed' END AS status, length(v.text) AS word_count, ty.reasons, outline_type FROM vw v LEFT JOIN ty USING (source_id)")
def _(s):
    return _processed(s).sources


@query("DOC02_outlines", ("sources",), f"""WITH RECURSIVE {MARKDOWN}, {VIEW}, {REASONS}, {MIXED}, {TYPED} SELECT *, {PLACE} FROM (
    SELECT o.source_id, o.line_start, o.line_end, o.level, o.title, o.parent_line, p.level AS parent_level, 'structural' AS node_type FROM ol o JOIN ty USING (source_id) LEFT JOIN ol p ON p.source_id = o.source_id AND p.line_start = o.parent_line WHERE outline_type <> 'semantic'
    UNION ALL SELECT *, 'semantic' FROM rn
    UNION ALL SELECT source_id, 1, total_lines, 1, CASE WHEN trim(left(trim(string_split(text, chr(10))[1]), 30)) = '' THEN 'untitled' ELSE left(trim(string_split(text, chr(10))[1]), 30) END, NULL, NULL, 'semantic' FROM ty JOIN tot USING (source_id) WHERE outline_type = 'semantic')""")
def _(s):
    return _processed(s).outlines


@query("DOC03_retry", ("sources",), f"WITH {MARKDOWN} SELECT s.source_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE count(ol.line_start) END AS outlines FROM sources s LEFT JOIN ol USING (source_id) GROUP BY s.source_id, s.status")
def _(s):
    rows, left = driver.retry(s, _parts(s)[2])
    n = left.groupBy("source_id").agg(F.count("*").alias("outlines"))
    return rows.join(n, "source_id", "left").select("source_id", "status", F.coalesce("outlines", F.lit(0)).alias("outlines"))


@query("DOC15_extractable", ("sources",), "SELECT source_id FROM sources WHERE status = 'completed'")
def _(s):
    return driver.extractable(s).select("source_id")


SECTIONS = f"""{MARKDOWN}, c AS (SELECT source_id, title, greatest(line_start - 2, 1) AS line_start, least(line_end + 3, total_lines) AS line_end, greatest(least(level + 1, 3), 1) AS level, total_lines FROM ol JOIN tot USING (source_id) WHERE trim(title) <> '' AND source_id % 9 <> 0),
    x AS (SELECT *, lead(level) OVER w AS nl, lead(line_start) OVER w AS ns, min(level) OVER (PARTITION BY source_id) AS top, row_number() OVER (PARTITION BY source_id ORDER BY level, line_start DESC, title DESC) AS last, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY source_id ORDER BY line_start, level, title)),
    y AS (SELECT source_id, title, line_start, CASE WHEN level = top AND last = 1 THEN total_lines WHEN nl = level THEN greatest(ns - 1, line_start) ELSE line_end END AS line_end, level, rn FROM x)"""


@query("DOC07_parse_sections", ("sources",), f"WITH {SECTIONS} SELECT a.source_id, a.title, a.line_start, a.line_end, a.level, (SELECT max(b.line_start) FROM y b WHERE b.source_id = a.source_id AND b.rn < a.rn AND b.level < a.level) AS parent_line FROM y a")
def _(s):
    """Replies with sections out of bounds; those of every ninth source are cut off."""
    _, totals, nodes = _parts(s)
    one = F.struct("title", (F.col("line_start") - 2).alias("line_start"), (F.col("line_end") + 3).alias("line_end"), (F.col("level") + 1).alias("level"))
    text = F.to_json(F.struct(F.collect_list(one).alias("sections")))
    replies = nodes.groupBy("source_id").agg(text.alias("reply"))
    replies = replies.withColumn("reply", F.when(F.col("source_id") % 9 == 0, F.left("reply", F.lit(20))).otherwise(F.col("reply")))
    return driver.parse_sections(replies, totals).select("source_id", "title", "line_start", "line_end", "level", "parent_line")


@query("SRT08_sections_in_order", ("sources",), f"WITH {SECTIONS} SELECT source_id, rn AS place, line_start, level FROM y")
def _(s):
    from pyspark.sql import Window as W

    _, totals, nodes = _parts(s)
    rows = nodes.filter("source_id % 9 <> 0").select("source_id", "title", (F.col("line_start") - 2).alias("line_start"), (F.col("line_end") + 3).alias("line_end"), (F.col("level") + 1).alias("level"))
    place = F.row_number().over(W.partitionBy("source_id").orderBy("line_start", "level", "title"))
    return dc.repair_sections(rows, totals).select("source_id", place.cast("bigint").alias("place"), "line_start", "level")


@query("DOC09_document_summary", ("sources", "domains"), "SELECT source_id, CASE WHEN substr(text, 1, 40) <> '' THEN substr(text, 1, 40) ELSE text END AS summary, d.domain_id FROM sources s LEFT JOIN domains d ON d.domain_id = 'src' || s.source_id % 9")
def _(s, d):
    return pv.document_summaries(s.select("source_id", "text"), d, pv.opening)


@query("DOC11_extract_units", ("sources",), """SELECT source_id, CASE WHEN text IS NULL THEN 'extraction_failed' ELSE 'completed' END AS status, coalesce(string_agg(i || ':' || left(x, 40), '|' ORDER BY i) FILTER (WHERE x <> ''), '') AS units, count(*) FILTER (WHERE x <> '') AS points
    FROM (SELECT source_id, text, i, trim(l[i]) AS x FROM (SELECT source_id, text, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM sources))) GROUP BY source_id, text""")
def _(s):
    got = pv.extract_units(s.select("source_id", F.lit(1).alias("line_start"), "text"), pv.line_units)
    named = F.transform("units", lambda u: F.concat(u["line_start"].cast("string"), F.lit(":"), u["center"]))
    return got.select("source_id", "status", F.array_join(named, "|").alias("units"), F.size("points").cast("bigint").alias("points"))


@query("RET02_outline_fallback", ("benchmark", "sources", "domains"), f"""WITH RECURSIVE {KQ}, {KC}, {RESTRICTED}, {KB}, {OUTLINE}, lo AS (SELECT DISTINCT q, source_id FROM oa WHERE best < 6), on2 AS (SELECT source_id, outline_id, row_number() OVER (PARTITION BY source_id ORDER BY outline_id) AS n FROM od)
    SELECT q, source_id, outline_id FROM lo JOIN on2 USING (source_id) WHERE n % 2 = 1""")
def _(b, s, d):
    """Sources whose best hit is weak are asked about; here a score under 6 is."""
    kb, q = _store(s, d), _questions(b)
    _, low = rt.outline_hits(q.select("q", F.col("topic").alias("text")), kb.outline_index, kb.outlines, s, rt.restrictions(_choices(b), d), 6.0)
    return pv.outline_fallback(low.join(q.select("q", F.col("text").alias("question")), "q"), kb.outlines, pv.every_other)


# --- providers -----------------------------------------------------------------------------------------


def _upper_all(requests: list[str]) -> list[str | None]:
    """Replies to a batch at once; none for names with a Y."""
    return [None if "Y" in r.upper() else json.dumps({"said": r.upper()}) for r in requests]


@query("UDF01_batch_provider", ("concepts",), "SELECT concept_id, CASE WHEN contains(name, 'Y') THEN NULL ELSE upper(name) END AS said FROM concepts")
def _(c):
    return c.select("concept_id", pv.ask_together(F.col("name"), _upper_all, "said string")["said"].alias("said"))


class _Shaky:
    """A transport that fails at first, then replies in noise, with a slip that breaks the schema until it is asked to mend it."""

    def __init__(self):
        self.calls = 0

    def __call__(self, request: str) -> str:
        self.calls += 1
        if self.calls == 1:
            raise OSError("no connection")
        if request.startswith('{"repair"'):
            return '{"name": "mended", "size": 1}'
        return 'Sure: ```json\n{"name": "' + request + '", "size": ' + ("1" if len(request) % 2 else '"one"') + ",}\n``` done"


_SCHEMA = {"type": "object", "required": ["name", "size"], "properties": {"name": {"type": "string", "minLength": 1}, "size": {"type": "integer"}}}


@query("UDF02_model_client", ("concepts",), "SELECT concept_id, CASE WHEN length(name) % 2 = 1 THEN name ELSE 'mended' END AS name, 1 AS size FROM concepts")
def _(c):
    """Retries, JSON in noise, the schema and one call to mend it; a client for each request."""

    def call(request: str) -> str:
        return schema.ModelClient(_Shaky(), sleep=lambda _: None).complete_json(request, _SCHEMA)

    return c.select("concept_id", pv.ask(F.col("name"), call, "name string, size int").alias("r")).select("concept_id", "r.name", "r.size")


@query("UDF03_fake_provider", ("concepts",), "SELECT concept_id, CASE concept_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN name END AS said FROM concepts")
def _(c):
    by_name = pv.fake({"short": lambda r: '{"said": "short"}', "echo": lambda r: json.dumps({"said": json.loads(r)["name"]})})
    prompt = F.element_at(F.array(F.lit("short"), F.lit("echo"), F.lit("unknown")), (F.col("concept_id") % 3 + 1).cast("int"))
    return c.select("concept_id", pv.ask(F.to_json(F.struct(prompt.alias("prompt"), "name")), by_name, "said string")["said"].alias("said"))


class _Service:
    """A conversion service in memory: two polls until done, refuses .exe, fails on empty files."""

    def __init__(self):
        self.tasks: dict[str, list] = {}

    def submit(self, name: str, content: bytes) -> tuple[str, str]:
        self.tasks[name] = [0, content]
        return name, "refused" if name.endswith(".exe") else "processing"

    def poll(self, task: str) -> tuple[str, str]:
        state = self.tasks[task]
        state[0] += 1
        return ("failed", "") if not state[1] else ("finished", task) if state[0] > 2 else ("processing", "")

    def download(self, at: str) -> bytes:
        return b"# " + self.tasks[at][1]


CONVERTED = "SELECT concept_id AS source_id, CASE WHEN concept_id % 5 < 3 THEN '# ' || name END AS text, CASE concept_id % 5 WHEN 3 THEN 'conversion failed' WHEN 4 THEN 'unexpected status refused' END AS error FROM concepts"


def _files(c: DataFrame) -> DataFrame:
    m = F.col("concept_id") % 5
    return c.select(F.col("concept_id").alias("source_id"), F.concat("name", F.when(m == 4, ".exe").otherwise(".doc")).alias("file_name"), F.when(m != 3, F.col("name").cast("binary")).alias("content"))


@query("SRC04_converter", ("concepts",), CONVERTED)
def _(c):
    return convert.to_markdown(_files(c), _Service, 0.0, 10.0)


@query("UDF04_converter_plugin", ("concepts",), CONVERTED.replace("'# ' || name", "'upper ' || name"))
def _(c):
    class Other(_Service):
        def download(self, at: str) -> bytes:
            return b"upper " + self.tasks[at][1]

    return convert.to_markdown(_files(c), Other, 0.0, 10.0)


@query("UDF05_sql_tokenizer", ("sources",), r"SELECT source_id, array_to_string(regexp_extract_all(lower(title), '[\p{L}\p{Nd}]+') || ['引擎', '擎测', '测试'], ' ') AS tokens FROM sources")
def _(s):
    tx.register(s.sparkSession)
    return s.sparkSession.sql("SELECT source_id, array_join(text_tokens(concat(title, ' 引擎测试')), ' ') AS tokens FROM {s}", s=s)


# --- scalars ---------------------------------------------------------------------------------------------


@query("FUN02_question_hash", ("benchmark",), r"SELECT item_id, substr(sha256(trim(regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '[^\p{L}\p{Nd} ]', '', 'g')) || chr(31) || 's'), 1, 32) AS hash FROM benchmark")
def _(b):
    return b.select("item_id", tx.question_hash(F.col("text"), F.lit("s")).alias("hash"))


_STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"


@query("FUN03_question_terms", ("benchmark",), rf"""SELECT item_id, left(terms, list_max(list_filter(range(0, length(terms) + 1), lambda i: strlen(left(terms, i)) <= 200))::INT) AS terms FROM (
    SELECT item_id, coalesce(array_to_string(list_sort(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+'), lambda t: t NOT IN {_STOP})), ' '), '') AS terms FROM (SELECT item_id, text || ' éàü' || text AS text FROM benchmark))""")
def _(b):
    return b.select("item_id", tx.question_terms(F.concat("text", F.lit(" éàü"), "text")).alias("terms"))


@query("FUN04_mixed_tokens", ("sources",), r"SELECT source_id, array_to_string(regexp_extract_all(lower(title), '[\p{L}\p{Nd}]+') || ['知识', '识图', '图谱', 'v2', '库'], ' ') AS tokens FROM sources")
def _(s):
    return s.select("source_id", F.array_join(tx.tokens(F.concat("title", F.lit(" 知识图谱v2 库"))), " ").alias("tokens"))


#: Letters as Han characters, to give the segmenter text.
_HAN = "知识图谱引擎测试数据分析系统设计开发平台服务应用管理"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
DICTIONARY = f"""hw AS (SELECT translate(w, '{_LETTERS}', '{_HAN}') AS w FROM (SELECT unnest(regexp_extract_all(lower(title), '[a-z]+')) AS w FROM sources)),
    hd AS (SELECT word, count(*) AS freq FROM (SELECT left(w, n) AS word FROM hw, (VALUES (2), (3), (5)) v(n) WHERE length(w) >= n) GROUP BY 1), hc AS (SELECT word, round(1000 * ln((SELECT sum(freq) FROM hd) / freq))::BIGINT AS cost FROM hd),
    hr AS (SELECT DISTINCT w AS run FROM (SELECT translate(array_to_string(regexp_extract_all(lower(title), '[a-z]+'), ''), '{_LETTERS}', '{_HAN}') AS w FROM sources) WHERE w <> ''),
    he AS (SELECT run, a + n - 1 AS e, list({{'cost': c, 'start': a}}) AS ins FROM (SELECT run, a, n, coalesce(cost, CASE WHEN n = 1 THEN (SELECT max(cost) + 1000 FROM hc) END) AS c FROM (SELECT run, a, unnest(range(1, least(5, length(run) - a + 1) + 1)) AS n FROM (SELECT run, unnest(range(1, length(run) + 1)) AS a FROM hr)) LEFT JOIN hc ON word = substr(run, a, n)) WHERE c IS NOT NULL GROUP BY run, a + n - 1),
    hv AS (SELECT run, 0::BIGINT AS i, [{{'cost': 0::BIGINT, 'start': 0::BIGINT}}] AS best FROM hr UNION ALL SELECT v.run, v.i + 1, list_append(best, list_min(list_transform(ins, lambda x: {{'cost': (best[x.start].cost + x.cost)::BIGINT, 'start': x.start::BIGINT}}))) FROM hv v JOIN he ON he.run = v.run AND he.e = v.i + 1),
    hb AS (SELECT run, length(run)::BIGINT AS e, ''::VARCHAR AS words, best FROM hv WHERE i = length(run) UNION ALL SELECT run, best[e + 1].start - 1, substr(run, best[e + 1].start, e - best[e + 1].start + 1) || CASE WHEN words = '' THEN '' ELSE ' ' END || words, best FROM hb WHERE e > 0)"""


@query("FUN05_dictionary_segments", ("sources",), rf"""WITH RECURSIVE {DICTIONARY}, ti AS (SELECT source_id, title, translate(array_to_string(regexp_extract_all(lower(title), '[a-z]+'), ''), '{_LETTERS}', '{_HAN}') AS run FROM sources)
    SELECT source_id, trim(array_to_string(regexp_extract_all(lower(title), '[\p{{L}}\p{{Nd}}]+'), ' ') || ' ' || coalesce(words, '')) AS tokens FROM ti LEFT JOIN (SELECT run, words FROM hb WHERE e = 0) USING (run)""")
def _(s):
    """Titles, and their letters as a run of Han text; the dictionary is the beginnings of the titles' words with their counts."""
    words = s.select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]+)"))).alias("w")).withColumn("w", F.translate("w", _LETTERS, _HAN))
    parts = words.select(F.explode(F.transform(F.filter(F.array(F.lit(2), F.lit(3), F.lit(5)), lambda n: F.char_length("w") >= n), lambda n: F.left("w", n))).alias("word"))
    han = F.translate(F.array_join(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]+)")), ""), _LETTERS, _HAN)
    texts = s.select(F.col("source_id").alias("key"), F.concat_ws(" ", "title", han).alias("text"))
    out = segment.segmented(texts, parts.groupBy("word").agg(F.count("*").alias("freq")))
    return out.select(F.col("key").alias("source_id"), F.array_join("tokens", " ").alias("tokens"))


@query("FUN12_schema_check", ("events",), """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '$: lacks k' WHEN event_id % 4 = 1 THEN '$.k: not integer' WHEN k > 50 THEN '$.k: over 50' ELSE '' END AS wrong FROM (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events)""")
def _(e):
    rule = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}}

    @F.pandas_udf("string")
    def wrong(texts):
        return texts.map(lambda t: "; ".join(schema.errors(json.loads(t), rule)))

    k = F.get_json_object("props", "$.k")
    m = F.col("event_id") % 4
    text = F.when(m == 0, "{}").when(m == 1, F.concat(F.lit('{"k":"'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"k":'), k, F.lit("}")))
    return e.select("event_id", wrong(text).alias("wrong"))


@query("FUN19_casts_and_dates", ("traces",), """SELECT trace_id, coalesce(nullif(question_terms, 'terms 7'), 'none') AS terms, round(point_id::DOUBLE / 7, 6) AS share, CAST(created_at AS DATE)::VARCHAR AS day, created_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY AS recent, question || ' / ' || path AS label FROM traces""")
def _(t):
    return t.select(
        "trace_id", F.coalesce(F.nullif("question_terms", F.lit("terms 7")), F.lit("none")).alias("terms"), F.round(F.col("point_id").cast("double") / 7, 6).alias("share"), F.to_date("created_at").cast("string").alias("day"),
        (F.col("created_at") >= F.expr("timestamp '2024-01-20 00:00:00' - interval 5 days")).alias("recent"), F.concat_ws(" / ", "question", "path").alias("label"),
    )


@query("SRC12_html_preview", ("sources",), "SELECT source_id, CASE WHEN source_id % 2 = 0 THEN '<p>' || title || '</p>' ELSE '<pre>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre>' END AS html FROM sources")
def _(s):
    html = F.when(F.col("source_id") % 2 == 0, F.concat(F.lit("<p>"), "title", F.lit("</p>")))
    return s.select("source_id", tx.html_preview(html, F.col("text")).alias("html"))


# --- sources and sinks -----------------------------------------------------------------------------------------


@query("SRC01_accept_uploads", ("sources",), """SELECT sha256(file_name) AS source_id, file_name, min(path) AS original_path, CASE m WHEN 1 THEN 'markdown' WHEN 2 THEN 'word' ELSE 'other' END AS format, 'pending' AS status
    FROM (SELECT 'f' || (source_id // 2) || CASE m WHEN 0 THEN '.exe' WHEN 1 THEN '.MD' WHEN 2 THEN '.docx' ELSE '.txt' END AS file_name, '/up/' || source_id AS path, m, source_id FROM (SELECT *, source_id // 2 % 4 AS m FROM sources)) WHERE m <> 0 AND file_name NOT IN ('f1.MD', 'f2.docx') GROUP BY file_name, m""")
def _(s):
    half = F.floor(F.col("source_id") / 2)
    ext = F.element_at(F.array(*map(F.lit, (".exe", ".MD", ".docx", ".txt"))), (half % 4 + 1).cast("int"))
    uploads = s.select(F.concat(F.lit("f"), half.cast("string"), ext).alias("file_name"), F.concat(F.lit("/up/"), F.col("source_id").cast("string")).alias("original_path"))
    known = s.sparkSession.createDataFrame([("f1.MD",), ("f2.docx",)], "file_name string")
    return files.accept(uploads, known)


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


@query("SRC08_seed_folder", ("domains",), "SELECT sha256(domain_id || '.md') AS source_id, domain_id || '.md' AS file_name, '# ' || name || chr(10) || 'text' AS text FROM domains WHERE domain_id <> 'src1'")
def _(d):
    spark, at = d.sparkSession, new_folder(d.sparkSession, "seed")
    for r in d.collect():  # a file for each domain, of which there are few
        _write(spark, f"{at}/{r['domain_id']}.md", f"# {r['name']}\ntext")
    _write(spark, f"{at}/notes.txt", "left out")
    return files.seed(spark, at, spark.createDataFrame([("src1.md",)], "file_name string"))


@query("SRC09_prompts", ("concepts",), "SELECT concept_id, 'v' || concept_id AS version, 'Keep {{name}}.' AS system, 'Ask about ' || name || ' and {{other}}.' AS \"user\", '{}' AS schema FROM concepts")
def _(c):
    def run(batches):
        import pandas as pd

        for rows in batches:
            out = []
            for i, name in rows.itertuples(index=False):
                p = prompts.parse_prompt(f"---\r\nversion: v{i}\r\n---\n## System\nKeep {{{{name}}}}.\n## User\nAsk about {{{{name}}}} and {{{{other}}}}.\n\n## Schema\n{{}}\n", {"name": name})
                out.append((i, p.version, p.system, p.user, p.schema))
            yield pd.DataFrame(out, columns=["concept_id", "version", "system", "user", "schema"])

    return c.select("concept_id", "name").mapInPandas(run, "concept_id bigint, version string, system string, user string, schema string")


_CONFIG = "# settings\nserver:\n  host: ${HOST}\n  port: 8080\nindex:\n  path: 'data/index'  \n  deep: true\n  words: [a, b]\nqueue:\n  workers: 2\n  timeout: 1.5\n"


@query("SRC10_configuration", ("region",), "SELECT * FROM (VALUES ('server.host', 'here'), ('server.port', '9090'), ('index.path', 'data/index'), ('index.deep', 'True'), ('index.words', '[''a'', ''b'']'), ('queue.workers', '2'), ('queue.timeout', '1.5')) v(name, value)")
def _(r):
    env = {"HOST": "here", "LORESPARK_SERVER_PORT": "9090", "LORESPARK_QUEUE_WORKERS": "many"}
    return r.sparkSession.createDataFrame([(k, str(v)) for k, v in config.parse(_CONFIG, env).items()], "name string, value string")


@query("SNK02_batch_insert", ("sources",), f"WITH {MARKDOWN} SELECT source_id, count(*) AS outlines, min(line_start) AS first_line FROM ol GROUP BY 1")
def _(s):
    spark, at = s.sparkSession, new_folder(s.sparkSession, "outlines")
    nodes = _parts(s)[2]
    for part in (0, 1):
        store.append(nodes.filter(F.col("source_id") % 2 == part), at)
    return spark.read.parquet(at).groupBy("source_id").agg(F.count("*").alias("outlines"), F.min("line_start").alias("first_line"))


@query("SNK08_status_times", ("events",), """SELECT user_id AS source_id, arg_max(status, (ts, status)) AS status, max(ts) FILTER (WHERE status = 'processing') AS started_at, max(ts) FILTER (WHERE status IN ('completed', 'failed')) AS ended_at
    FROM (SELECT *, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status FROM events) GROUP BY 1""")
def _(e):
    kind = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return store.status_times(e.select(F.col("user_id").alias("source_id"), kind.alias("status"), F.col("ts").alias("at")))


@query("SNK15_snapshots", ("concepts", "domains"), "SELECT 'concepts' AS name, 3 AS version, (SELECT count(*) FROM concepts) AS rows UNION ALL SELECT 'domains', 3, (SELECT count(*) FROM domains)")
def _(c, d):
    """Three snapshots of which two are kept; the newest one, its tables whole, is restored."""
    spark, at = c.sparkSession, new_folder(c.sparkSession, "snapshots")
    for _ in range(3):
        snapshot.backup(spark, {"concepts": c, "domains": d}, at, 2)
    newest = snapshot.versions(spark, at)[-1] if len(snapshot.versions(spark, at)) == 2 else -1
    out = None
    for name, df in snapshot.restore(spark, at).items():
        one = df.agg(F.lit(name).alias("name"), F.lit(newest).alias("version"), F.count("*").alias("rows")).select("name", "version", "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SNK16_migrations", ("concepts",), "SELECT concept_id, upper(name) AS name, domain_id + 1 AS domain, '1_capitals,2_domains_from_one,3_without_thirds' AS ran, 4 AS version FROM concepts WHERE concept_id % 3 <> 0")
def _(c):
    """Migrations of a store in versions run in order and once: the second call finds two done and runs the third."""
    spark = c.sparkSession
    steps = [
        ("1_capitals", lambda v: {"concepts": v.table("concepts").withColumn("name", F.upper("name"))}),
        ("2_domains_from_one", lambda v: {"concepts": v.table("concepts").select("concept_id", "name", (F.col("domain_id") + 1).alias("domain"))}),
        ("3_without_thirds", lambda v: {"concepts": v.table("concepts").filter("concept_id % 3 <> 0")}),
    ]
    begun = versions.open_version(spark, new_folder(spark, "migrated")).commit({"concepts": c})
    begun.migrate(steps[:2])
    done = versions.open_version(spark, begun.root).migrate(steps)
    return done.table("concepts").select("concept_id", "name", "domain", F.lit(",".join(done.migrations)).alias("ran"), F.lit(done.number).alias("version"))


@query("SNK16_pending", ("concepts",), "SELECT concept_id AS version, name FROM concepts WHERE concept_id % 3 <> 0")
def _(c):
    rows = c.select(F.col("concept_id").alias("version"), "name")
    return store.pending_migrations(rows, rows.filter("version % 3 = 0"))


@query("PRJ03_source_page", ("sources", "domains"), "SELECT source_id, name, (SELECT count(*) FROM sources) AS total FROM sources LEFT JOIN domains USING (domain_id) ORDER BY source_id DESC LIMIT 20 OFFSET 40")
def _(s, d):
    return store.page(s.join(d, "domain_id", "left").select("source_id", "name"), [F.desc("source_id")], 20, 3)


@query("SRT07_ordered_listings", ("turns", "domains"), "SELECT 'turns' AS list, row_number() OVER (ORDER BY session_id, turn_index) AS place, session_id || '/' || turn_index AS item FROM (SELECT * FROM turns ORDER BY session_id, turn_index LIMIT 30) UNION ALL SELECT 'domains', row_number() OVER (ORDER BY name), name FROM domains")
def _(t, d):
    """Listings keep their order: places are counted over the sorted rows."""
    from pyspark.sql import Window as W

    turns = store.listing(t, {}, [F.col("session_id"), F.col("turn_index")], 30).select(F.lit("turns").alias("list"), F.struct("session_id", "turn_index").alias("o"), F.concat_ws("/", F.col("session_id").cast("string"), F.col("turn_index").cast("string")).alias("item"))
    names = store.listing(d, {}, [F.col("name")]).select(F.lit("domains").alias("list"), F.col("name").alias("o"), F.col("name").alias("item"))
    place = lambda df: df.select("list", F.row_number().over(W.partitionBy("list").orderBy("o")).cast("bigint").alias("place"), "item")
    return place(turns).unionByName(place(names))


@query("WIN12_open_and_next", ("turns",), "SELECT session_id, max(turn_index) FILTER (WHERE answer_id IS NULL) AS open_turn, coalesce(max(turn_index), 0) + 1 AS next_index FROM turns GROUP BY 1")
def _(t):
    return store.next_turn_index(t).join(store.latest_open(t).select("session_id", F.col("turn_index").alias("open_turn")), "session_id", "left").select("session_id", "open_turn", "next_index")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: rel.QUERIES.pop(n) for n in _OWN}
SQL: dict[str, str] = {n: rel.SQL.pop(n) for n in _OWN if n in rel.SQL}
