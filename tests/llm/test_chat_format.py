import random

from pyspark.sql import functions as F

from lorespark.llm import chat_format as cf


def esc(s):
    s = s.replace("\\", "\\\\")
    for c in cf.CONTROL:
        s = s.replace(c, c[0] + "\\" + c[1:])
    return s


def brute(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append(((t is not None, t), r or "user" if r is None else r, x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        text, spans, last = "", [], None
        for _, role, x in turns:
            if role != last:
                text += ("[/INST]</s>" if last is not None else "") + "<s>" + esc(role) + "[INST]"
            else:
                text += "[SEP]"
            if role == "assistant":
                spans.append((len(text), len(text) + len(esc(x))))
            text, last = text + esc(x), role
        out.append((c, text + "[/INST]</s>", spans, [(r, x) for _, r, x in turns]))
    return sorted(out, key=str)


def test_round_trip(spark):
    rnd = random.Random(1)
    bits = [*cf.CONTROL, "\\", "<\\s>", "a", "é", "𝒳", "\n", " ", "ok"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "<s>", ""]), rnd.choice([None, "".join(rnd.choices(bits, k=rnd.randrange(9)))]), "y") for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [rows[0], (None, 0, "user", "x", "y"), (77, None, "assistant", "late", "y"), (77, 0, "assistant", "z" * 100_000, "y"), (-1, 0, "user", "</s>[INST] ok [/INST]", "y"), (-1, 1, "assistant", "</s>[INST] ok [/INST]", "y")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t string").repartition(3)
    out = cf.chat_format(df).withColumns({"turns": cf.read_back(F.col("formatted")), "loss": cf.masked(F.col("formatted"), F.col("loss_spans"))})
    got = sorted(((r["conv_id"], r["formatted"], [tuple(s) for s in r["loss_spans"]], [tuple(t) for t in r["turns"]]) for r in out.collect()), key=str)
    assert got == brute(rows)
    for r in out.collect():
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")


def test_empty(spark):
    assert cf.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_many_turns(spark):
    rows = [(1, t, "assistant" if t % 3 else "user", f"{t}é" * (t % 5), "y") for t in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t string").repartition(3)
    out = cf.chat_format(df).withColumn("loss", cf.masked(F.col("formatted"), F.col("loss_spans"))).collect()
    assert [(r["conv_id"], r["formatted"], [tuple(s) for s in r["loss_spans"]]) for r in out] == [x[:3] for x in brute(rows)]
    assert out[0]["loss"] == "".join(x for _, _, r, x, _ in rows if r == "assistant")
