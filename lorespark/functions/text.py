"""Text scalars as column expressions; only built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that results depend on -----------------------------------------------------
STOP_WORDS = (
    "的 是 吗 了 在 有 和 与 或 不 也 都 就 这 那 被 把 让 给 从 到 对 为 以 什么 怎么 哪些 如何 为何 什 么 哪 "
    "what is the a an how why where when who which are was were be been being have has had do does did will would "
    "can could should shall may might must it its this that of in on at to for with by from and or not no"
).split()
SPLITTERS = "如何 是否 能否 怎么样 怎么 怎样 为什么 什么 多少 哪些 ， 。 ？ ? ！ 、 ： 的 中 呢 吗 了 是".split()
COMMON = "什么 哪些 怎么 如何 多少 怎样 为什么 是否 能否 查询 查看 帮我 看看 分析 标准 怎么样 是多少 有哪些".split()
INTERRUPT = "停 停下 别说了 不用了 清空 重来 重置 从头 算了重来".split()
REASONING = "如果 假设 假定 假如 若是 多少 计算 算出 比较 对比 哪个更 为什么 原因是什么 经历了哪些 哪些阶段 什么流程 应该怎么 如何处理".split()
CONTINUE = "继续 下一个 再看一个 按刚才 基于上面".split()
FORMATS = {
    "word": ".doc .docx", "excel": ".xls .xlsx", "pdf": ".pdf .ofd", "markdown": ".md .markdown",
    "image": ".jpg .jpeg .png .bmp .tif .tiff", "other": ".ppt .pptx .wps .et .dps .rtf .txt",
}
# ----------------------------------------------------------------------------------------------


def normalise_question(q: Column) -> Column:
    """Trimmed, lower-cased, runs of white space as one blank, all but letters, digits and blanks dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(q)), r"(?U)\s+", " "), r"[^\p{L}\p{Nd} ]", ""))


def question_hash(question: Column, subject: Column) -> Column:
    return F.substring(F.sha2(F.concat(normalise_question(question), F.lit("\x1f"), F.coalesce(subject, F.lit(""))), 256), 1, 32)


def tokens(text: Column) -> Column:
    """Lower-cased tokens: runs of letters and digits; a run of Han characters gives its pairs (alone: itself)."""
    lower = F.lower(text)
    runs = F.regexp_extract_all(lower, F.lit(r"([\p{IsHan}]+|[\p{L}\p{Nd}&&[^\p{IsHan}]]+)"))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^[\p{IsHan}]"), pairs(r)).otherwise(F.array(r))))
    # Han characters are all in this range; asking for a character's script takes most of the time
    return F.when(lower.rlike(r"[\x{2E80}-\x{10FFFF}]"), mixed).otherwise(F.regexp_extract_all(lower, F.lit(r"([\p{L}\p{Nd}]+)")))


def register(spark, name: str = "text_tokens") -> None:
    """Makes :func:`tokens` a function of SQL in this session; it stays an expression, so nothing leaves the JVM."""
    spark.sql(rf"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS ARRAY<STRING> RETURN flatten(transform(
        regexp_extract_all(lower(x), r'([\p{{IsHan}}]+|[\p{{L}}\p{{Nd}}&&[^\p{{IsHan}}]]+)'),
        r -> CASE WHEN r RLIKE r'^[\p{{IsHan}}]' THEN transform(sequence(1, greatest(char_length(r) - 1, 1)), i -> substring(r, i, 2)) ELSE array(r) END))""")


def cut_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters that has at most ``limit`` bytes."""
    ends = F.filter(F.sequence(F.lit(0), F.least(F.char_length(text), F.lit(limit))), lambda i: F.octet_length(F.substring(text, F.lit(1), i)) <= limit)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(text, F.lit(1), F.array_max(ends)))


def question_terms(q: Column) -> Column:
    """Sorted tokens without stop words, repeats kept, joined by blanks and cut at 200 bytes."""
    kept = F.filter(tokens(q), lambda t: ~t.isin(STOP_WORDS))
    return cut_bytes(F.array_join(F.array_sort(kept), " "), 200)


def key_phrases(q: Column) -> Column:
    """Parts of 2 to 8 characters between separators and white space, without common words."""
    out = q
    for s in SPLITTERS:
        out = F.replace(out, F.lit(s), F.lit(" "))
    return F.filter(F.split(F.trim(out), r"(?U)\s+"), lambda s: F.char_length(s).between(2, 8) & ~s.isin(COMMON))


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def needs_reasoning(question: Column) -> Column:
    return contains_any(question, REASONING)


def is_interrupt(text: Column) -> Column:
    return contains_any(F.trim(text), INTERRUPT)


def is_continuation(text: Column, goes_on: Column) -> Column:
    """A wish to go on counts only if there is something to go on with."""
    return (F.coalesce(goes_on, F.lit("")) != "") & contains_any(F.trim(text), CONTINUE)


def segmented(text: Column, words: list[str]) -> Column:
    """Han runs cut by forward maximum matching with a list of words (a character without one stands alone); lower-cased, other runs whole.

    The words make one pattern, longest first, as a pattern takes the first of its choices.
    """
    import re

    known = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    pattern = f"({known}|" + r"\p{IsHan}|[\p{L}\p{Nd}&&[^\p{IsHan}]]+)" if known else r"(\p{IsHan}|[\p{L}\p{Nd}&&[^\p{IsHan}]]+)"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern))


def server_event(text: Column) -> Column:
    """Text as the data of a server-sent event: line ends escaped."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))


def recent_subjects(subjects: Column) -> Column:
    """At most three subjects as a JSON list, each cut at 60 characters."""
    return F.to_json(F.transform(F.slice(subjects, 1, 3), lambda s: F.left(s, F.lit(60))))


def whole_number(text: Column, default: int) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*(-?\d{1,9})\s*$", 1), F.lit("")), F.lit("S999999999")).cast("int"), F.lit(default))


def file_format(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    pairs = [F.lit(x) for kind, exts in FORMATS.items() for e in exts.split() for x in (e, kind)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit("other"))


def normalise_keywords(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "，,、；;", "     "), " +", " "))


def first_paragraph(text: Column) -> Column:
    """Up to 300 characters of the lines that are neither blank nor headings, each with its newline."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return F.left(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit(300))


def json_from_noise(text: Column) -> Column:
    """The outermost object or array of a text, code fences dropped; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)(\{.*\}|\[.*\])", 1)
    return F.nullif(found, F.lit(""))


def strip_think(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?(</think>|$)", ""))


def expand_query(text: Column, intent: Column, subject: Column) -> Column:
    """Intent and subject in place of a shorter input."""
    i, s = F.coalesce(intent, F.lit("")), F.coalesce(subject, F.lit(""))
    built = F.when((i != "") & (s != ""), F.when(F.contains(i, s), i).otherwise(F.concat(s, F.lit(" "), i))).otherwise(F.concat(i, s))
    return F.when((built != "") & (F.char_length(text) < F.char_length(built)), built).otherwise(text)


def topic(intent: Column, subject: Column, current: Column) -> Column:
    about = F.coalesce(F.nullif(subject, F.lit("")), F.nullif(current, F.lit("")))
    return F.when(about.isNotNull(), F.concat(intent, F.lit(" - "), about)).otherwise(intent)


def title(text: Column, given: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), F.left(text, F.lit(30)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.floor(F.char_length(text) / 1.5), F.lit(10)).cast("bigint")


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, inclusive, clamped); empty if there are none."""
    lines = F.split(text, "\n")
    a, b = F.greatest(start, F.lit(1)), F.least(end, F.size(lines))
    return F.when(a <= b, F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n")).otherwise("")


def numbered_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def html_preview(html: Column, markdown: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(markdown, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.coalesce(html, F.concat(F.lit("<pre>"), escaped, F.lit("</pre>")))


def valid_citations(ids: Column, known: Column) -> Column:
    """Ids that are known, in order, repeats kept."""
    return F.filter(ids, lambda x: F.array_contains(known, x))
