"""Queries of indexes, recalls and the whole retrieval, over a store made of the documents' lines."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import docs as dc
from lorespark.operators import index as ix
from lorespark.operators import retrieval as rt
from lorespark.operators import store
from lorespark.operators import tree
from lorespark.plans import relational as rel
from lorespark.plans.knowledge import MARKDOWN, _mark, _parts
from lorespark.sources.shared import new_folder, shared_dir, state_of, stored, temporary

_OWN: list[str] = []


def query(name: str, names: tuple[str, ...], sql: str | None):
    _OWN.append(name)
    return rel.query(name, names, sql)


# --- the store: a unit for each line that isn't blank, its text in points of 60 characters, relations between neighbours ---

STEP = 100_000
KB = f"""{MARKDOWN},
    od AS (SELECT *, source_id * {STEP} + line_start AS outline_id, source_id * {STEP} + parent_line AS parent_id FROM ol),
    ku AS (SELECT source_id * {STEP} + i AS unit_id, source_id, i::BIGINT AS line_start, i::BIGINT AS line_end, l[i] AS content, CASE WHEN (source_id + i) % 9 = 0 THEN 'extraction_failed' ELSE 'completed' END AS status,
        source_id * {STEP} + (SELECT max(h.line_no) FROM hd h WHERE h.source_id = x.source_id AND h.line_no <= i) AS outline_id
        FROM (SELECT source_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source_id, string_split(text, chr(10)) AS l FROM sources)) x WHERE trim(l[i]) <> ''),
    kp AS (SELECT unit_id * 10 AS point_id, unit_id, left(content, 60) AS content FROM ku WHERE unit_id % 5 <> 4
        UNION ALL SELECT unit_id * 10 + 1, unit_id, substr(content, 61, 60) FROM ku WHERE unit_id % 5 <> 4 AND length(content) > 60),
    kr AS (SELECT a.unit_id * 10 AS source_point, b.unit_id * 10 AS target_point, CASE WHEN b.unit_id % 4 = 0 THEN 'contradicts' ELSE 'related' END AS relation_type,
        CASE WHEN b.unit_id % 2 = 0 THEN 'directed' ELSE 'bidirectional' END AS direction FROM ku a JOIN ku b ON b.unit_id = a.unit_id + 1 WHERE a.unit_id % 5 <> 4 AND b.unit_id % 5 <> 4),
    cu AS (SELECT * FROM ku WHERE status = 'completed'), cp AS (SELECT kp.* FROM kp JOIN cu USING (unit_id))"""


def _outlines(s: DataFrame) -> DataFrame:
    nodes = _parts(s)[2]
    return nodes.select("*", (F.col("source_id") * STEP + F.col("line_start")).alias("outline_id"), (F.col("source_id") * STEP + F.col("parent_line")).alias("parent_id"))


def _lines(s: DataFrame) -> DataFrame:
    """Units as they stand in their sources' rows, without the outline's node: nothing is shuffled."""
    status = F.when((F.col("source_id") + F.col("line_no")) % 9 == 0, "extraction_failed").otherwise("completed")
    rows = dc.lines(s).filter("trim(line) <> ''")
    return rows.select((F.col("source_id") * STEP + F.col("line_no")).alias("unit_id"), "source_id", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.col("line").alias("content"), status.alias("status"))


def _units(s: DataFrame) -> DataFrame:
    """Units with the node of the last heading up to their line; lines are shuffled once, without their text where it isn't asked for."""
    line = F.concat(_mark(F.col("line_no")), "line")
    status = F.when((F.col("source_id") + F.col("line_no")) % 9 == 0, "extraction_failed").otherwise("completed")
    rows = dc.lines(s).select("source_id", "line_no", F.col("line").alias("content"), (F.trim("line") != "").alias("_full"), F.ltrim(line).startswith("```").alias("is_fence"), line.rlike(dc.HEADING).alias("_head"))
    head = F.when(F.col("_head") & ~F.col("is_fence") & ~F.col("in_code"), F.col("line_no"))
    rows = dc.coded(rows).withColumn("_last", F.last(head, ignorenulls=True).over(W.partitionBy("source_id").orderBy("line_no"))).filter("_full")
    return rows.select((F.col("source_id") * STEP + F.col("line_no")).alias("unit_id"), "source_id", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "content", status.alias("status"), (F.col("source_id") * STEP + F.col("_last")).alias("outline_id"))


def _points(u: DataFrame) -> DataFrame:
    rows = u.filter("unit_id % 5 <> 4")
    first = rows.select((F.col("unit_id") * 10).alias("point_id"), "unit_id", F.left("content", F.lit(60)).alias("content"))
    return first.unionByName(rows.filter(F.char_length("content") > 60).select((F.col("unit_id") * 10 + 1).alias("point_id"), "unit_id", F.substring("content", 61, 60).alias("content")))


def _relations(u: DataFrame) -> DataFrame:
    n = u.filter("unit_id % 5 <> 4").select("unit_id")
    b = F.col("unit_id")
    pairs = n.join(n.select((F.col("unit_id") + 1).alias("unit_id"), F.col("unit_id").alias("a")), "unit_id")
    return pairs.select((F.col("a") * 10).alias("source_point"), (b * 10).alias("target_point"), F.when(b % 4 == 0, "contradicts").otherwise("related").alias("relation_type"), F.when(b % 2 == 0, "directed").otherwise("bidirectional").alias("direction"))


def _at(s: DataFrame, name: str) -> str:
    """The folder of an index of this application over these files as they are now."""
    sc = s.sparkSession.sparkContext
    return temporary(s.sparkSession, f"{shared_dir(s.sparkSession)}/lorespark/index-{sc.applicationId}-{hashlib.sha256(state_of(s).encode()).hexdigest()[:16]}/{name}")


def _index(s: DataFrame, name: str) -> ix.Index:
    """The stored index of a corpus; the first query that needs it makes it."""
    made: dict[str, Callable[[], DataFrame]] = {
        "text": lambda: s.select(F.col("source_id").alias("doc"), "text"),
        "title": lambda: s.select(F.col("source_id").alias("doc"), F.col("title").alias("text")),
        "units": lambda: _lines(s).filter("status = 'completed'").select(F.col("unit_id").alias("doc"), F.col("content").alias("text")),
        "points": lambda: _points(_lines(s).filter("status = 'completed'")).select(F.col("point_id").alias("doc"), F.col("content").alias("text")),
        "outlines": lambda: _stored_outlines(s).select(F.col("outline_id").alias("doc"), F.col("title").alias("text")),
    }
    return ix.open_or_create(s.sparkSession, _at(s, name), made[name])


def _table(s: DataFrame, name: str, df: Callable[[], DataFrame]) -> DataFrame:
    """A table of the store, written by the first query that needs it."""
    from lorespark.sources.shared import exists

    spark, path = s.sparkSession, _at(s, f"table-{name}")
    if not exists(spark, f"{path}/_SUCCESS"):
        df().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _stored_outlines(s: DataFrame) -> DataFrame:
    return _table(s, "outlines", lambda: _outlines(s).select("outline_id", "parent_id", "source_id", "title", "level", "line_start", "line_end"))


class _Store:
    """The store (:class:`rt.Store`), each of whose tables and indexes is made when it is first asked for. Texts stay in the sources."""

    def __init__(self, sources: DataFrame, domains: DataFrame):
        self.sources, self.domains = sources, domains

    outlines = cached_property(lambda self: _stored_outlines(self.sources))
    units = cached_property(lambda self: _table(self.sources, "units", lambda: _units(self.sources).drop("content")))
    relations = cached_property(lambda self: _table(self.sources, "relations", lambda: _relations(self.units)))
    unit_index = cached_property(lambda self: _index(self.sources, "units"))
    point_index = cached_property(lambda self: _index(self.sources, "points"))
    outline_index = cached_property(lambda self: _index(self.sources, "outlines"))

    @cached_property
    def points(self) -> DataFrame:
        """Those of completed units."""
        return _table(self.sources, "points", lambda: _points(_lines(self.sources).filter("status = 'completed'")).select("point_id", "unit_id"))


def _store(s: DataFrame, d: DataFrame) -> _Store:
    return _Store(s, d)


def _candidates(b: DataFrame, s: DataFrame, d: DataFrame, kb: _Store) -> DataFrame:
    """The candidates of the questions with their contents, which several queries go on from; the first of them makes the table."""
    asked = hashlib.sha256(state_of(b).encode()).hexdigest()[:16]

    def made() -> DataFrame:
        found = rt.contents(rt.candidates(_questions(b), _choices(b), kb).drop("source_id"), kb)
        return found.join(_questions(b).select("q", F.col("text").alias("question")), "q")

    return _table(s, f"candidates-{asked}", made)


# --- questions: the first words of the benchmark's items ---

KQ = "kq AS (SELECT item_id AS q, array_to_string(list_slice(string_split(text, ' '), 1, 12), ' ') AS text, array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ') AS topic FROM benchmark)"
#: Every third question is left to all domains, some name one that doesn't exist.
KC = "kc AS (SELECT q, 'src' || (q % 23) AS domain_id FROM kq WHERE q % 3 <> 0 UNION ALL SELECT q, 'src' || (q % 5) FROM kq WHERE q % 3 = 1)"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{Nd}}]+')"


def _questions(b: DataFrame) -> DataFrame:
    words = F.split("text", " ")
    return b.select(F.col("item_id").alias("q"), F.array_join(F.slice(words, 1, 12), " ").alias("text"), F.array_join(F.slice(words, 1, 6), " ").alias("topic"))


def _choices(b: DataFrame) -> DataFrame:
    q = F.col("item_id")
    one = b.filter(q % 3 != 0).select(q.alias("q"), F.concat(F.lit("src"), (q % 23).cast("string")).alias("domain_id"))
    return one.unionByName(b.filter(q % 3 == 1).select(q.alias("q"), F.concat(F.lit("src"), (q % 5).cast("string")).alias("domain_id")))


def bm25(name: str, corpus: str, question: str = "text") -> str:
    """CTEs that end in ``name``: q, doc, score, rank of the best hundred; ``corpus`` selects doc and text."""
    return f"""{name}_q AS (SELECT DISTINCT q, unnest({TOKENS.format(question)}) AS term FROM kq),
    {name}_t AS (SELECT doc, {TOKENS.format('text')} AS ts FROM ({corpus})), {name}_tf AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM {name}_t) GROUP BY ALL),
    {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1), {name}_st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {name}_t),
    {name}_sc AS (SELECT q, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM {name}_tf JOIN {name}_df USING (term) JOIN {name}_q USING (term), {name}_st GROUP BY ALL),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM {name}_sc) WHERE rank <= 100)"""


TEXT = bm25("m", "SELECT source_id AS doc, text FROM sources")
TITLE = bm25("h", "SELECT source_id AS doc, title AS text FROM sources")


def _match(b: DataFrame, s: DataFrame, name: str) -> DataFrame:
    return rt.match(_questions(b), _index(s, name))


@query("FTS01_postings", ("sources",), f"SELECT term, doc, len(ts)::BIGINT AS dl, count(*)::BIGINT AS tf FROM (SELECT source_id AS doc, ts, unnest(ts) AS term FROM (SELECT source_id, {TOKENS.format('text')} AS ts FROM sources)) GROUP BY term, doc, len(ts)")
def _(s):
    return _index(s, "text").postings()


CORPORA = "('units', (SELECT count(*) FROM cu), (SELECT sum(len({u})) FROM cu)), ('points', (SELECT count(*) FROM cp), (SELECT sum(len({u})) FROM cp)), ('outlines', (SELECT count(*) FROM od), (SELECT sum(len({t})) FROM od))".format(u=TOKENS.format("content"), t=TOKENS.format("title"))


@query("FTS01_three_corpora", ("sources",), f"WITH {KB} SELECT * FROM (VALUES {CORPORA}) v(corpus, docs, tokens)")
def _(s):
    out = None
    for name in ("units", "points", "outlines"):
        one = _index(s, name).docs().agg(F.lit(name).alias("corpus"), F.count("*").alias("docs"), F.sum("dl").alias("tokens")).select("corpus", "docs", "tokens")
        out = one if out is None else out.unionByName(one)
    return out


@query("FTS02_put_and_replace", ("sources",), f"SELECT doc, count(*)::BIGINT AS terms, sum(tf)::BIGINT AS tokens FROM (SELECT doc, term, count(*) AS tf FROM (SELECT source_id AS doc, unnest({TOKENS.format('text')}) AS term FROM (SELECT source_id, CASE WHEN source_id % 10 = 3 THEN title ELSE text END AS text FROM sources WHERE source_id % 7 <> 2)) GROUP BY ALL) GROUP BY 1")
def _(s):
    """Three generations: half of the documents, the others and new texts of some, and some taken out."""
    index = ix.open_or_create(s.sparkSession, new_folder(s.sparkSession, "index"))
    rows = s.select(F.col("source_id").alias("doc"), "text", "title")
    index.put(rows.filter("doc % 2 = 0").select("doc", "text"))
    index.put(rows.filter("doc % 2 = 1 OR doc % 10 IN (3, 8)").select("doc", F.when(F.col("doc") % 10 == 3, F.col("title")).otherwise(F.col("text")).alias("text")))
    index.remove(rows.filter("doc % 7 = 2").select("doc"))
    return index.postings().groupBy("doc").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))


@query("FTS03_match", ("benchmark", "sources"), f"WITH {KQ}, {TEXT} SELECT q, doc, score, rank FROM m")
def _(b, s):
    return _match(b, s, "text")


@query("FTS04_probe", ("sources",), "SELECT true AS found, count(*) AS docs FROM sources")
def _(s):
    index = ix.open_or_create(s.sparkSession, new_folder(s.sparkSession, "index"), lambda: s.select(F.col("source_id").alias("doc"), F.col("title").alias("text")))
    found = ix.probe(index)
    return index.docs().agg(F.lit(found).alias("found"), F.count("*").alias("docs"))


@query("FTS05_self_healing", ("sources",), "SELECT false AS was_healthy, true AS is_healthy, count(*) AS docs FROM sources")
def _(s):
    """An index that lost a third of its documents is made again."""
    rows = s.select(F.col("source_id").alias("doc"), F.col("title").alias("text"))
    index = ix.open_or_create(s.sparkSession, new_folder(s.sparkSession, "index"), lambda: rows.filter("doc % 3 <> 0"))
    was = ix.ensure_healthy(index, rows)
    now = ix.ensure_healthy(index, rows)
    return index.docs().agg(F.lit(was).alias("was_healthy"), F.lit(now).alias("is_healthy"), F.count("*").alias("docs"))


@query("FTS06_source_filter", ("benchmark", "sources"), f"WITH {KQ}, {TEXT} SELECT q, doc, rank FROM m WHERE doc % 4 = 1")
def _(b, s):
    ids = s.filter("source_id % 4 = 1").select("source_id")
    return rt.only_sources(_match(b, s, "text").withColumnRenamed("doc", "source_id"), ids).select("q", F.col("source_id").alias("doc"), "rank")


@query("SRC13_open_or_create", ("sources",), "SELECT count(*) AS docs, 1 AS generations FROM sources")
def _(s):
    """Opened twice, made once."""
    spark, path = s.sparkSession, new_folder(s.sparkSession, "index")
    for _ in range(2):
        index = ix.open_or_create(spark, path, lambda: s.select(F.col("source_id").alias("doc"), F.col("title").alias("text")))
    return index.docs().agg(F.count("*").alias("docs"), F.lit(len(index.generations())).alias("generations"))


@query("SNK07_delete_failed", ("sources",), f"""WITH gone AS (SELECT source_id FROM sources WHERE status = 'failed' AND source_id % 8 IN (2, 3)) SELECT source_id, status, (SELECT count(DISTINCT t) FROM (SELECT unnest({TOKENS.format('title')}) AS t)) AS terms
    FROM sources WHERE source_id NOT IN (SELECT source_id FROM gone)""")
def _(s):
    """Only failed ones of those asked for go, from the table and from the index."""
    index = ix.open_or_create(s.sparkSession, new_folder(s.sparkSession, "index"), lambda: s.select(F.col("source_id").alias("doc"), F.col("title").alias("text")))
    kept, gone = store.delete_failed(s, s.filter("source_id % 8 IN (2, 3)").select("source_id"))
    index.remove(gone.select(F.col("source_id").alias("doc")))
    terms = index.postings().groupBy(F.col("doc").alias("source_id")).agg(F.count("*").alias("terms"))
    return kept.join(terms, "source_id", "left").select("source_id", "status", F.coalesce("terms", F.lit(0)).alias("terms"))


# --- recalls ---


@query("AGG14_best_per_question", ("benchmark", "sources"), f"WITH {KQ}, {TEXT} SELECT q, max(score) AS best, string_agg(doc, ',' ORDER BY rank) AS docs FROM m GROUP BY 1")
def _(b, s):
    hits = F.array_sort(F.collect_list(F.struct("rank", "doc")))
    return _match(b, s, "text").groupBy("q").agg(F.max("score").alias("best"), F.array_join(F.transform(hits, lambda h: h["doc"].cast("string")), ",").alias("docs"))


@query("SRT04_top_before_filter", ("benchmark", "sources"), f"WITH {KQ}, {TEXT} SELECT q, doc, rank FROM m JOIN sources ON source_id = doc WHERE status = 'completed'")
def _(b, s):
    ok = s.filter("status = 'completed'").select(F.col("source_id").alias("doc"))
    return _match(b, s, "text").join(ok, "doc", "left_semi").select("q", "doc", "rank")


FUSED = """u AS (SELECT q, doc, 1.0::DOUBLE / (60 + rank) AS s, '1' AS path FROM m UNION ALL SELECT q, doc, 1.0::DOUBLE / (60 + rank), '0' FROM h),
    g AS (SELECT q, doc, round(sum(s), 9) AS score, string_agg(path, ',' ORDER BY path) AS paths FROM u GROUP BY ALL)"""


@query("RET04_rrf", ("benchmark", "sources"), f"WITH {KQ}, {TEXT}, {TITLE}, {FUSED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM g) WHERE rank <= 20")
def _(b, s):
    return rt.fuse(_match(b, s, "title"), _match(b, s, "text"))


@query("SET02_keyed_union", ("benchmark", "sources"), f"WITH {KQ}, {TEXT}, {TITLE}, {FUSED} SELECT q, doc, score, paths FROM g")
def _(b, s):
    return rt.fuse(_match(b, s, "title"), _match(b, s, "text"), limit=1 << 30).drop("rank")


@query("AGG15_rrf_sums", ("benchmark", "sources"), f"WITH {KQ}, {TEXT}, {TITLE}, {FUSED} SELECT doc, sum(score::DECIMAL(18, 9))::DOUBLE AS total, count(*) AS questions FROM g GROUP BY 1")
def _(b, s):
    fused = rt.fuse(_match(b, s, "title"), _match(b, s, "text"), limit=1 << 30)
    return fused.groupBy("doc").agg(F.sum(F.col("score").cast("decimal(18,9)")).cast("double").alias("total"), F.count("*").alias("questions"))


@query("SRT01_best_twenty", ("benchmark", "sources"), f"WITH {KQ}, {TEXT} SELECT q, doc, score, rank FROM m ORDER BY score DESC, q, doc LIMIT 20")
def _(b, s):
    return _match(b, s, "text").orderBy(F.desc("score"), "q", "doc").limit(20)


RESTRICTED = "qr AS (SELECT DISTINCT q, domain_id FROM kc JOIN domains USING (domain_id))"


def allowed(hits: str, source: str = "source_id") -> str:
    return f"SELECT x.* FROM {hits} x JOIN sources s ON s.source_id = x.{source} WHERE x.q NOT IN (SELECT q FROM qr) OR s.domain_id IS NULL OR EXISTS (SELECT 1 FROM qr WHERE qr.q = x.q AND qr.domain_id = s.domain_id)"


@query("FLT02_chosen_sources", ("benchmark", "sources", "domains"), f"WITH {KQ}, {KC}, {RESTRICTED}, {TEXT} SELECT q, doc, rank FROM ({allowed('m', 'doc')})")
def _(b, s, d):
    hits = _match(b, s, "text").withColumnRenamed("doc", "source_id")
    return rt.allowed(hits, s, rt.restrictions(_choices(b), d)).select("q", F.col("source_id").alias("doc"), "rank")


OUTLINE = f"""{bm25('o', 'SELECT outline_id AS doc, title AS text FROM od', 'topic')}, oh AS (SELECT q, doc AS outline_id, score, source_id FROM o JOIN od ON outline_id = doc),
    oa AS (SELECT *, max(score) OVER (PARTITION BY q, source_id) AS best FROM ({allowed('oh')})), ok AS (SELECT q, source_id, outline_id FROM oa WHERE best >= 0.5),
    be AS (SELECT q, outline_id FROM ok UNION SELECT be.q, c.outline_id FROM be JOIN od c ON c.parent_id = be.outline_id), fp AS (SELECT unit_id, min(point_id) AS first_point FROM cp GROUP BY 1),
    orc AS (SELECT be.q, cu.unit_id, cu.source_id, first_point AS point_id, 1.0::DOUBLE AS score FROM be JOIN cu USING (outline_id) JOIN fp USING (unit_id))"""


@query("RET01_outline_recall", ("benchmark", "sources", "domains"), f"WITH RECURSIVE {KQ}, {KC}, {RESTRICTED}, {KB}, {OUTLINE} SELECT * FROM orc")
def _(b, s, d):
    kb = _store(s, d)
    q = _questions(b).select("q", F.col("topic").alias("text"))
    hits, _ = rt.outline_hits(q, kb.outline_index, kb.outlines, s, rt.restrictions(_choices(b), d))
    return rt.outline_recall(hits, kb.outlines, kb.units, kb.points)


UNITS = f"""{bm25('hu', 'SELECT unit_id AS doc, content AS text FROM cu')}, {bm25('hp', 'SELECT point_id AS doc, content AS text FROM cp')},
    bo AS (SELECT q, doc AS unit_id, score, NULL::BIGINT AS point_id FROM hu UNION ALL SELECT q, unit_id, score, doc FROM hp JOIN cp ON point_id = doc),
    on1 AS (SELECT q, unit_id, max(score) AS score, arg_max(point_id, (score, -point_id)) FILTER (WHERE point_id IS NOT NULL) AS best_point FROM bo GROUP BY ALL),
    ou AS (SELECT on1.*, source_id FROM on1 JOIN ku USING (unit_id)),
    ur AS (SELECT q, unit_id, source_id, coalesce(best_point, f.first_point) AS point_id, score FROM ({allowed('ou')}) y LEFT JOIN (SELECT unit_id, min(point_id) AS first_point FROM cp GROUP BY 1) f USING (unit_id) WHERE coalesce(best_point, f.first_point) IS NOT NULL)"""


@query("RET03_unit_recall", ("benchmark", "sources", "domains"), f"WITH {KQ}, {KC}, {RESTRICTED}, {KB}, {UNITS} SELECT * FROM ur")
def _(b, s, d):
    kb = _store(s, d)
    return rt.unit_recall(_questions(b), kb.unit_index, kb.point_index, kb.units, kb.points, s, rt.restrictions(_choices(b), d))


@query("AGG13_best_per_unit", ("benchmark", "sources"), f"WITH {KQ}, {KB}, {bm25('hp', 'SELECT point_id AS doc, content AS text FROM cp')} SELECT q, unit_id, max(score) AS score, arg_max(doc, (score, -doc)) AS point_id FROM hp JOIN cp ON point_id = doc GROUP BY ALL")
def _(b, s):
    hits = _match(b, s, "points")
    return hits.groupBy("q", F.floor(F.col("doc") / 10).alias("unit_id")).agg(F.max("score").alias("score"), F.max_by("doc", F.struct("score", -F.col("doc"))).alias("point_id"))


# --- classification, expansion, evidence ---

_split = "text"
for _w in tx.SPLITTERS:
    _split = f"replace({_split}, '{_w}', ' ')"
PHRASES = rf"list_filter(string_split_regex(trim({_split}), '\s+'), lambda p: length(p) BETWEEN 2 AND 8 AND p NOT IN ({', '.join(repr(w) for w in tx.COMMON)}))"

MERGED = """ro AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, unit_id) AS r, '0' AS path FROM orc), rf AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, unit_id) AS r, '1' AS path FROM ur),
    mg AS (SELECT q, unit_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, string_agg(path, ',' ORDER BY path) AS paths, arg_min(point_id, path) AS point_id FROM (SELECT * FROM ro UNION ALL SELECT * FROM rf) GROUP BY ALL),
    ca AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, unit_id) AS rank FROM mg) WHERE rank <= 20)"""
ROLES = f"""sh AS (SELECT ca.q, ca.unit_id, ca.point_id, kq.text, ku.content, list_distinct({TOKENS.format('kq.text')}) AS qt, {TOKENS.format('ku.content')} AS ct FROM ca JOIN kq USING (q) JOIN ku USING (unit_id)),
    sr AS (SELECT *, len(list_intersect(qt, ct)) AS hit, {PHRASES} AS ph FROM sh),
    ke AS (SELECT q, unit_id, point_id, CASE WHEN 2 * hit >= len(qt) AND (len(ph) = 0 OR len(list_filter(ph, lambda p: contains(content, p))) > 0) THEN 'direct' ELSE 'supporting' END AS role FROM sr WHERE hit > 0)"""
EXPANDED = """sd AS (SELECT q, point_id FROM ke JOIN cp USING (unit_id) WHERE role = 'direct'), """.replace("SELECT q, point_id FROM ke JOIN cp USING (unit_id)", "SELECT ke.q, cp.point_id FROM ke JOIN cp ON cp.unit_id = ke.unit_id") + """
    ed AS (SELECT source_point AS a, target_point AS b, relation_type FROM kr UNION SELECT target_point, source_point, relation_type FROM kr WHERE direction = 'bidirectional' OR relation_type = 'contradicts'),
    ne AS (SELECT DISTINCT sd.q, ed.b AS point_id, ed.relation_type FROM sd JOIN ed ON ed.a = sd.point_id WHERE NOT EXISTS (SELECT 1 FROM sd x WHERE x.q = sd.q AND x.point_id = ed.b)),
    fr AS (SELECT ne.q, cp.unit_id, min(ne.point_id) AS point_id FROM ne JOIN cp USING (point_id) WHERE relation_type <> 'contradicts' AND NOT EXISTS (SELECT 1 FROM ke WHERE ke.q = ne.q AND ke.unit_id = cp.unit_id) GROUP BY ALL),
    ag AS (SELECT ne.q, cp.unit_id, ne.point_id FROM ne JOIN cp USING (point_id) WHERE relation_type = 'contradicts'),
    ev AS (SELECT q, unit_id, point_id, role FROM ke UNION ALL SELECT q, unit_id, point_id, 'supporting' FROM fr UNION ALL SELECT q, unit_id, point_id, 'conflict' FROM ag)"""
ALL = f"{KQ}, {KC}, {RESTRICTED}, {KB}, {OUTLINE}, {UNITS}, {MERGED}"


@query("RET05_rerank", ("benchmark", "sources", "domains"), f"WITH RECURSIVE {ALL}, {ROLES} SELECT * FROM ke")
def _(b, s, d):
    return rt.classify(_candidates(b, s, d, _store(s, d))).select("q", "unit_id", "point_id", "role")


@query("FLT21_phrase_in_text", ("benchmark", "sources"), f"WITH {KQ}, {TEXT}, x AS (SELECT m.q, m.doc, kq.text, s.text AS content FROM m JOIN kq USING (q) JOIN sources s ON s.source_id = m.doc WHERE rank <= 10) SELECT q, doc, len(list_filter({PHRASES}, lambda p: contains(content, p))) > 0 AS named FROM x")
def _(b, s):
    hits = _match(b, s, "text").filter("rank <= 10").join(_questions(b).select("q", F.col("text").alias("question")), "q").join(s.select(F.col("source_id").alias("doc"), F.col("text").alias("content")), "doc")
    return hits.select("q", "doc", F.exists(tx.key_phrases(F.col("question")), lambda p: F.contains(F.col("content"), p)).alias("named"))


@query("FUN08_key_phrases", ("benchmark",), f"WITH {KQ} SELECT q, array_to_string({PHRASES}, '|') AS phrases FROM (SELECT q, text || '什么是标准，如何计算的中引擎' AS text FROM kq)")
def _(b):
    text = F.concat(F.col("text"), F.lit("什么是标准，如何计算的中引擎"))
    return _questions(b).select("q", F.array_join(tx.key_phrases(text), "|").alias("phrases"))


@query("RET06_expand", ("benchmark", "sources", "domains"), f"WITH RECURSIVE {ALL}, {ROLES}, {EXPANDED} SELECT 'new' AS kind, q, unit_id, point_id FROM fr UNION ALL SELECT 'against', q, unit_id, point_id FROM ag")
def _(b, s, d):
    kb = _store(s, d)
    fresh, against = rt.expand(stored(rt.classify(_candidates(b, s, d, kb)).select("q", "unit_id", "point_id", "role"), "kept"), kb.relations, kb.points)
    return fresh.select(F.lit("new").alias("kind"), "q", "unit_id", "point_id").unionByName(against.select(F.lit("against").alias("kind"), "q", "unit_id", "point_id"))


@query("RET07_path", ("benchmark", "sources", "domains"), f"WITH RECURSIVE {ALL}, {ROLES} SELECT q, CASE WHEN count_if(role = 'direct') > 0 THEN 'short' ELSE 'deep' END AS path FROM ke GROUP BY 1")
def _(b, s, d):
    return rt.path(rt.classify(_candidates(b, s, d, _store(s, d))))


# --- evidence and citations of the questions --------------------------------------------------------


def _evidence(b: DataFrame, s: DataFrame, d: DataFrame) -> DataFrame:
    """``q``, and its evidence in order of rank: struct of point_id, role, unit_id; questions without any have none."""
    kept = rt.classify(_candidates(b, s, d, _store(s, d)))
    found = kept.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "point_id", "role", "unit_id"))).alias("evidence"))
    return b.select(F.col("item_id").alias("q")).join(found, "q", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<rank:bigint,point_id:bigint,role:string,unit_id:bigint>>")))


CITED = "ct AS (SELECT kq.q, coalesce(list(point_id ORDER BY rank) FILTER (WHERE ca.unit_id % 3 <> 0), []) AS cited, coalesce(list(point_id ORDER BY rank) FILTER (WHERE role = 'direct'), []) AS direct, coalesce(list(point_id ORDER BY rank) FILTER (WHERE role IS NOT NULL), []) AS every FROM kq LEFT JOIN (SELECT ca.*, role FROM ca JOIN ke USING (q, unit_id)) ca USING (q) GROUP BY kq.q)"


def _cited(b: DataFrame, s: DataFrame, d: DataFrame) -> DataFrame:
    """What answers cite: the points of two thirds of the evidence, each cited twice, and one that is no evidence between."""
    e = _evidence(b, s, d)
    once = F.transform(F.filter("evidence", lambda x: x["unit_id"] % 3 != 0), lambda x: x["point_id"])
    ids = lambda keep: F.transform(F.filter("evidence", keep), lambda x: x["point_id"])
    return e.select("q", F.concat(once, F.array(F.lit(-1).cast("bigint")), once).alias("cited"), ids(lambda x: x["role"] == "direct").alias("direct"), ids(lambda x: x["role"].isNotNull()).alias("every"))


@query("FLT19_valid_citations", ("benchmark", "sources", "domains"), f"WITH RECURSIVE {ALL}, {ROLES}, {CITED} SELECT q, array_to_string(list_concat(cited, cited), ',') AS citations FROM ct")
def _(b, s, d):
    return _cited(b, s, d).select("q", F.array_join(tx.valid_citations(F.col("cited"), F.col("every")), ",").alias("citations"))


@query("JOI14_cited_evidence", ("benchmark", "sources", "domains"), f"WITH RECURSIVE {ALL}, {ROLES}, {CITED} SELECT q, array_to_string(list_filter(cited, lambda x: list_contains(direct, x)), ',') AS cited_direct, array_to_string(list_filter(cited, lambda x: NOT list_contains(direct, x)), ',') AS cited_supporting FROM ct")
def _(b, s, d):
    """Cited evidence in the order of its first citation, once each, by role."""
    supporting = F.array_except("every", "direct")
    return _cited(b, s, d).select("q", F.array_join(F.array_intersect("cited", "direct"), ",").alias("cited_direct"), F.array_join(F.array_intersect("cited", supporting), ",").alias("cited_supporting"))


@query("SET05_intersection", ("benchmark", "sources", "domains"), f"WITH RECURSIVE {ALL} SELECT kq.q, coalesce(string_agg(unit_id::VARCHAR, ',' ORDER BY rank) FILTER (WHERE paths = '0,1'), '') AS both_paths FROM kq LEFT JOIN ca USING (q) GROUP BY kq.q")
def _(b, s, d):
    """Units that both recalls found, in order of rank."""
    c = _candidates(b, s, d, _store(s, d))
    on = lambda path: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rank", "unit_id", "paths"))), lambda x: F.contains(x["paths"], F.lit(path))), lambda x: x["unit_id"])
    found = c.groupBy("q").agg(F.array_join(F.array_intersect(on("0"), on("1")), ",").alias("both"))
    return b.select(F.col("item_id").alias("q")).join(found, "q", "left").select("q", F.coalesce("both", F.lit("")).alias("both_paths"))


@query("WIN01_ranks", ("benchmark", "sources"), f"WITH {KQ}, {TEXT} SELECT q, doc, rank - 1 AS rank FROM m")
def _(b, s):
    """Places by score, from 0, of what a search found; equal scores by document."""
    return store.ranked(_match(b, s, "text").select("q", "doc", "score"), "q", F.col("score"), "doc").select("q", "doc", "rank")


EVIDENCE = """pa AS (SELECT q, CASE WHEN count_if(role = 'direct') > 0 THEN 'short' ELSE 'deep' END AS path FROM ke GROUP BY 1)
    SELECT ev.q, ev.unit_id, ev.point_id, role, path, content, '{"source_id":' || s.source_id || ',"line_start":' || line_start || ',"line_end":' || line_end || '}' AS source_ref, CASE WHEN role = 'conflict' THEN s.title END AS source_title
    FROM ev JOIN ku ON ku.unit_id = ev.unit_id JOIN sources s ON s.source_id = ku.source_id JOIN pa ON pa.q = ev.q"""


@query("RET09_retrieve", ("benchmark", "sources", "domains"), f"WITH RECURSIVE {ALL}, {ROLES}, {EXPANDED}, {EVIDENCE}")
def _(b, s, d):
    return rt.retrieve(_questions(b), _choices(b), _store(s, d))


@query("RET08_evidence", ("points", "units", "sources", "relations"), """WITH pr AS (SELECT source_point AS point_id, target_point AS other FROM relations WHERE relation_type = 'contradicts' UNION SELECT target_point, source_point FROM relations WHERE relation_type = 'contradicts'),
    cf AS (SELECT pr.point_id, array_to_string(list_sort(list(DISTINCT p.content)), '|') AS conflicts FROM pr JOIN points p ON p.point_id = pr.other GROUP BY 1)
    SELECT p.point_id, p.content, '{"source_id":' || u.source_id || ',"unit_id":' || p.unit_id || '}' AS source_ref, coalesce(conflicts, '') AS conflicts FROM points p JOIN units u USING (unit_id) JOIN sources s USING (source_id) LEFT JOIN cf ON cf.point_id = p.point_id""")
def _(p, u, s, r):
    from lorespark.operators import answer

    return answer.evidence(p, u, s, r)


@query("JOI12_top_groups", ("sources",), f"""WITH {MARKDOWN}, rt AS (SELECT source_id, line_start, title, coalesce(lead(line_start) OVER (PARTITION BY source_id ORDER BY line_start) - 1, total_lines) AS line_end FROM ol JOIN tot USING (source_id) WHERE parent_line IS NULL)
    SELECT md.source_id, coalesce(rt.title, 'ungrouped') AS grp, count(*) AS n FROM md LEFT JOIN rt ON rt.source_id = md.source_id AND md.line_no BETWEEN rt.line_start AND rt.line_end GROUP BY ALL""")
def _(s):
    md, totals, nodes = _parts(s)
    return tree.groups_of_lines(md.select("source_id", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end")), nodes, totals).groupBy("source_id", "grp").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: rel.QUERIES.pop(n) for n in _OWN}
SQL: dict[str, str] = {n: rel.SQL.pop(n) for n in _OWN if n in rel.SQL}
