"""Steps that a model answers, over any provider: a function from a request (JSON text) to a reply (JSON text).

A provider is called in the executors, a batch of rows at a time, and asked again if it raises or
replies with something that isn't a JSON object; after ``attempts`` calls the reply is null and the step's
own rule for failures holds. The functions ``first_lines`` to ``cite_all`` are deterministic providers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import docs as dc
from lorespark.operators import tree

Provider = Callable[[str], str]
#: A provider that takes the requests of a batch together and gives as many replies, null where it failed.
BatchProvider = Callable[[list[str]], list[str | None]]
#: Concepts that a request may list.
MAX_CONCEPTS = 5_000
#: Rows whose requests and replies a task of :func:`ask_rows` holds at a time.
ROWS = 256


def fake(by_prompt: dict[str, Provider]) -> Provider:
    """A deterministic provider for tests: requests name their prompt, each of which has a provider of its own."""

    def call(request: str) -> str:
        return by_prompt[json.loads(request)["prompt"]](request)

    return call


def reply(provider: Provider, request: str | None, attempts: int) -> str | None:
    for _ in range(attempts if request is not None else 0):
        try:
            out = provider(request)
            if isinstance(json.loads(out), dict):
                return out
        except Exception:  # whatever a provider raises counts as no reply
            continue
    return None


def ask(request: Column, provider: Provider, schema: str, attempts: int = 2) -> Column:
    """The provider's reply, read by ``schema``; null where it failed."""

    @F.pandas_udf("string")
    def call(requests: pd.Series) -> pd.Series:
        return pd.Series([reply(provider, r, attempts) for r in requests], dtype=object)

    return F.from_json(call.asNondeterministic()(request), schema)


def ask_rows(rows: DataFrame, request: Column, provider: Provider, schema: str, keep: list[str], attempts: int = 2) -> DataFrame:
    """The columns ``keep`` of ``rows``, and ``r``, the reply as of :func:`ask`; a task holds the requests and replies of ``ROWS`` rows at a time."""
    size = ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                got = pa.array([reply(provider, r, attempts) for r in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], names=batch.schema.names)

    told = rows.select(*keep, request.alias("r"))
    return told.mapInArrow(run, told.schema).withColumn("r", F.from_json("r", schema))


def ask_together(request: Column, provider: BatchProvider, schema: str, attempts: int = 2) -> Column:
    """As :func:`ask`, with one call for all requests of a batch; what failed is asked for again, together."""

    @F.pandas_udf("string")
    def call(requests: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(requests)
        open_ = [i for i, r in enumerate(requests) if r is not None]
        for _ in range(attempts):
            if not open_:
                break
            try:
                replies = provider([requests.iloc[i] for i in open_])
            except Exception:  # whatever a provider raises counts as no reply
                continue
            for i, r in zip(open_, replies):
                out[i] = reply(lambda _, r=r: r, "", 1)
            open_ = [i for i in open_ if out[i] is None]
        return pd.Series(out, dtype=object)

    return F.from_json(call.asNondeterministic()(request), schema)


def batches(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Numbers the rows of each ``by`` with batches of ``size`` rows."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size))


# --- documents -----------------------------------------------------------------------------------


def request_chars(usable: int) -> int:
    """Characters of a text that a request of ``usable`` tokens may hold."""
    return usable * 3 // 2


def node_summaries(nodes: DataFrame, provider: Provider, budget: int = 3000) -> DataFrame:
    """Keywords of outline nodes, asked for in batches of a token budget; a node without a reply keeps its title."""
    tokens = F.greatest(F.lit(10), F.ceil(F.char_length("title") / 1.5)).cast("bigint")
    numbered = dc.greedy_batches(nodes.select("source_id", "line_start", tokens.alias("tokens")), budget)
    rows = nodes.join(numbered, ["source_id", "line_start"])
    asked = rows.groupBy("source_id", "batch").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("line_start", "title"))).alias("nodes"))).alias("q"))
    got = asked.select("source_id", F.explode(ask(F.col("q"), provider, "summaries array<struct<line_start: bigint, keywords: string>>")["summaries"]).alias("s")).select("source_id", "s.*")
    got = got.withColumn("keywords", tx.normalise_keywords(F.col("keywords"))).dropDuplicates(["source_id", "line_start"])
    return nodes.join(got, ["source_id", "line_start"], "left").select("source_id", "line_start", F.coalesce(F.nullif("keywords", F.lit("")), "title").alias("summary"))


def outline_fallback(pairs: DataFrame, outlines: DataFrame, provider: Provider) -> DataFrame:
    """``q, source_id, outline_id`` that a model names for questions (q, source_id, question) from a source's outline; failures and unknown ids name nothing."""
    listed = outlines.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("outline_id", "title"))).alias("outlines"))
    asked = pairs.join(listed, "source_id")
    got = asked.select("q", "source_id", "outlines", F.explode(ask(F.to_json(F.struct("question", "outlines")), provider, "outline_ids array<bigint>")["outline_ids"]).alias("outline_id"))
    return got.filter(F.exists("outlines", lambda o: o["outline_id"] == F.col("outline_id"))).select("q", "source_id", "outline_id").distinct()


def document_summaries(docs: DataFrame, domains: DataFrame, provider: Provider) -> DataFrame:
    """A document's summary, its first paragraph if none comes, and the domain named, if it exists."""
    got = docs.withColumn("r", ask(F.to_json(F.struct("source_id", "text")), provider, "summary string, domain_id string"))
    first = tx.first_paragraph(F.col("text"))
    rows = got.select("source_id", F.coalesce(F.nullif(F.col("r.summary"), F.lit("")), first).alias("summary"), F.col("r.domain_id").alias("named"))
    return rows.join(domains.select(F.col("domain_id").alias("named"), F.col("domain_id")).distinct(), "named", "left").select("source_id", "summary", "domain_id")


# --- units ---------------------------------------------------------------------------------------


def extract_units(segments: DataFrame, provider: Provider) -> DataFrame:
    """Per segment (source_id, line_start, text): status, units and points; units without center, lines or a full point are dropped."""
    schema = "units array<struct<unit_id: string, center: string, line_start: bigint, line_end: bigint>>, points array<struct<point_id: string, unit_id: string, content: string, type: string>>"
    got = ask_rows(segments, F.to_json(F.struct("line_start", "text")), provider, schema, ["source_id", "line_start"])
    points = F.coalesce("r.points", F.array())
    own = lambda u: F.filter(points, lambda p: p["unit_id"] == u["unit_id"])
    empty = lambda p: F.trim(F.coalesce(p["content"], F.lit(""))) == ""
    fine = F.filter("r.units", lambda u: (F.coalesce(u["center"], F.lit("")) != "") & (u["line_start"] <= u["line_end"]) & (F.size(own(u)) > 0) & ~F.exists(own(u), empty))
    out = got.select("source_id", "line_start", F.when(F.col("r.units").isNull(), "extraction_failed").otherwise("completed").alias("status"), F.coalesce(fine, F.array()).alias("units"), points.alias("points"))
    return out.withColumn("points", F.filter("points", lambda p: F.exists("units", lambda u: u["unit_id"] == p["unit_id"])))


def related_batches(points: DataFrame, units: DataFrame, outlines: DataFrame, size: int = 60) -> DataFrame:
    """``source_id, grp, batch`` and the points (array of point_id, center, content) that are asked about together.

    Up to ``size`` points of a source go together. Of more, those of a chapter do, the root above their unit's outline node
    (points without one have a group of their own), ``size`` at a time in order of id.
    """
    top = tree.root_of(outlines.select("outline_id", "parent_id"), "outline_id", "parent_id").select("outline_id", F.col("root").alias("chapter"))
    rows = points.select("point_id", "unit_id", "content").join(units.select("unit_id", "source_id", "outline_id", "center"), "unit_id").join(top, "outline_id", "left")
    many = rows.groupBy("source_id").agg((F.count("*") > size).alias("many"))
    # a chapter is numbered in one place; only ids are sorted there, contents join afterwards
    grp = F.when(F.col("many"), F.coalesce(F.col("chapter").cast("string"), F.lit("ungrouped"))).otherwise("all")
    placed = rows.join(many, "source_id").select("source_id", "point_id", grp.alias("grp"))
    placed = placed.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("source_id", "grp").orderBy("point_id")) - 1) / size))
    told = placed.join(rows.select("source_id", "point_id", "center", "content"), ["source_id", "point_id"])
    return told.groupBy("source_id", "grp", "batch").agg(F.array_sort(F.collect_list(F.struct("point_id", "center", "content"))).alias("points"))


def relations(points: DataFrame, units: DataFrame, outlines: DataFrame, provider: Provider, size: int = 60) -> DataFrame:
    """Relations between points of a source that are asked about together: both ends known and different, of a known type; stored in both directions."""
    told = related_batches(points, units, outlines, size).withColumn("known", F.transform("points", lambda p: p["point_id"]))
    got = ask_rows(told, F.to_json(F.struct("points")), provider, "relations array<struct<`from`: bigint, `to`: bigint, type: string>>", ["known"])
    rows = got.select("known", F.explode("r.relations").alias("x"))
    ok = F.array_contains("known", F.col("x.from")) & F.array_contains("known", F.col("x.to")) & (F.col("x.from") != F.col("x.to")) & F.col("x.type").isin("related", "contradicts")
    return rows.filter(ok).select(F.col("x.from").alias("source_point"), F.col("x.to").alias("target_point"), F.col("x.type").alias("relation_type"), F.lit("bidirectional").alias("direction")).distinct()


def match_concepts(units: DataFrame, concepts: DataFrame, provider: Provider, size: int = 50) -> DataFrame:
    """Units' concepts, asked for in batches with the list of concepts, a curated table of ``MAX_CONCEPTS`` at most; only concepts that exist count."""
    if concepts.limit(MAX_CONCEPTS + 1).count() > MAX_CONCEPTS:
        raise ValueError(f"more than {MAX_CONCEPTS} concepts; a request lists all of them")
    listed = concepts.agg(F.array_sort(F.collect_list(F.struct("concept_id", "name"))).alias("concepts"))  # one row
    asked = batches(units.select("source_id", "unit_id", "center"), "source_id", "unit_id", size).groupBy("source_id", "batch").agg(F.array_sort(F.collect_list(F.struct("unit_id", "center"))).alias("units"))
    got = asked.crossJoin(F.broadcast(listed)).select(ask(F.to_json(F.struct("units", "concepts")), provider, "matches array<struct<unit_id: bigint, concept_id: bigint>>").alias("r"))
    rows = got.select(F.explode("r.matches").alias("m")).select("m.*").dropDuplicates(["unit_id"])
    known = rows.join(concepts.select("concept_id"), "concept_id", "left_semi")
    return units.select("unit_id").join(known, "unit_id", "left")


# --- answers -------------------------------------------------------------------------------------

NO_EVIDENCE = "No evidence was found for this question."
FAILED = "The answer could not be made; please try again."


def generate(questions: DataFrame, provider: Provider) -> DataFrame:
    """Answers to questions (q, question, evidence: array of id and content) with citations that the evidence has; constants without evidence or reply."""
    has = F.size(F.coalesce("evidence", F.array())) > 0
    got = questions.withColumn("r", ask(F.when(has, F.to_json(F.struct("question", "evidence"))), provider, "content string, citations array<string>"))
    known = F.transform("evidence", lambda e: e["id"])
    cited = F.filter(F.coalesce("r.citations", F.array()), lambda c: F.array_contains(known, c))
    content = F.when(~has, NO_EVIDENCE).when(F.col("r.content").isNull(), FAILED).otherwise(F.col("r.content"))
    return got.select("q", content.alias("content"), F.when(has, cited).otherwise(F.array().cast("array<string>")).alias("citations"))


# --- deterministic providers -----------------------------------------------------------------------


def first_lines(request: str) -> str:
    """One section of level 1 for each request, named by its first line, with which it begins."""
    j = json.loads(request)
    title = j["text"].split("\n")[0].strip()[:30] or "untitled"
    return json.dumps({"sections": [{"title": title, "line_start": j["line_start"], "line_end": j["line_end"], "level": 1}], "starts_mid_section": False})


def sections_of_lines(request: str, steps: dict[int, int]) -> str:
    """Sections of as many lines as the level that is asked for has, named by their first line's number."""
    j = json.loads(request)
    n = steps[j["level"]]
    starts = range(j["line_start"], j["line_end"] + 1, n)
    return json.dumps({"sections": [{"title": f"part {a}", "line_start": a, "line_end": min(a + n - 1, j["line_end"])} for a in starts]})


def sections_of_headings(request: str) -> str:
    """A text's headings, or a window's as a sketch; merges keep all units, each from its start to the next one's."""
    j = json.loads(request)
    if j.get("prompt") != "merge":
        heads = [(j["line_start"] + i, x.lstrip("#").strip()) for i, x in enumerate(j["text"].split("\n")) if x.startswith("#")]
        ends = [a - 1 for a, _ in heads[1:]] + [j["line_end"]]
        units = [{"title": t, "line_start": a, "line_end": b, "level": 1} for (a, t), b in zip(heads, ends)]
        return json.dumps({"sections": units, "starts_mid_section": not heads or heads[0][0] > j["line_start"], "ends_mid_section": j["line_end"] < j.get("total_lines", 0)})
    units = {u["line_start"]: u["title"] for s in j["sketches"] for u in s["units"]}
    starts, last = sorted(units), max(s["until"] for s in j["sketches"])
    return json.dumps({"sections": [{"title": units[a], "line_start": a, "line_end": b - 1, "level": 1} for a, b in zip(starts, [*starts[1:], last + 1])]})


def every_other(request: str) -> str:
    """The outlines at even places of the list, and one that doesn't exist."""
    return json.dumps({"outline_ids": [o["outline_id"] for o in json.loads(request)["outlines"][::2]] + [-1]})


def title_words(request: str) -> str:
    return json.dumps({"summaries": [{"line_start": n["line_start"], "keywords": n["title"] + " key"} for n in json.loads(request)["nodes"]]})


def opening(request: str) -> str:
    """The first 40 characters, and a domain by the id's remainder, which may not exist."""
    j = json.loads(request)
    return json.dumps({"summary": j.get("text", "")[:40], "domain_id": f"src{j['source_id'] % 9}"})


def line_units(request: str) -> str:
    """A unit with one point for each line that isn't blank."""
    j = json.loads(request)
    kept = [(j["line_start"] + i, x.strip(" ")) for i, x in enumerate(j["text"].split("\n")) if x.strip(" ")]
    return json.dumps({
        "units": [{"unit_id": f"u{n}", "center": x[:40], "line_start": n, "line_end": n} for n, x in kept],
        "points": [{"point_id": f"p{n}", "unit_id": f"u{n}", "content": x, "type": "fact"} for n, x in kept],
    })


def neighbours_related(request: str) -> str:
    ids = [p["point_id"] for p in json.loads(request)["points"]]
    return json.dumps({"relations": [{"from": a, "to": b, "type": "related"} for a, b in zip(ids, ids[1:])]})


def by_length(request: str) -> str:
    j = json.loads(request)
    ids = [c["concept_id"] for c in j["concepts"]]
    return json.dumps({"matches": [{"unit_id": u["unit_id"], "concept_id": ids[len(u["center"]) % len(ids)]} for u in j["units"]]})


def cite_all(request: str) -> str:
    """Cites all evidence and one id that isn't evidence."""
    ids = [e["id"] for e in json.loads(request)["evidence"]]
    return json.dumps({"content": f"{len(ids)} findings", "citations": [*ids, "unknown"]})
