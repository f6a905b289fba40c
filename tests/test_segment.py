import itertools
import math
import random

from lorespark.operators import segment


def brute(run, cost, unknown):
    """The cheapest of all cuts; of equal ones that whose last words are longest."""
    best = None
    for bits in itertools.product([0, 1], repeat=len(run) - 1):
        cuts = [0, *(i + 1 for i, b in enumerate(bits) if b), len(run)]
        words = [run[a:b] for a, b in zip(cuts, cuts[1:])]
        price = [cost.get(w, unknown if len(w) == 1 else None) for w in words]
        if None not in price:
            best = min(best or (math.inf,), (sum(price), [-len(w) for w in reversed(words)], words))
    return best[2]


def words_of(spark, freq):
    return spark.createDataFrame(list(freq.items()), "word string, freq long")


def tokens(spark, texts, freq):
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    return {r["key"]: r["tokens"] for r in segment.segmented(rows, words_of(spark, freq)).collect()}


def test_texts_that_greedy_cutting_gets_wrong(spark):
    freq = {"研究": 50, "研究生": 30, "生命": 60, "命": 5, "起源": 40, "的": 500, "结婚": 50, "和": 100, "和尚": 10, "尚未": 30, "未": 5}
    got = tokens(spark, ["研究生命的起源", "结婚的和尚未结婚的 ABC12 x"], freq)
    assert got == {0: ["研究", "生命", "的", "起源"], 1: ["结婚", "的", "和", "尚未", "结婚", "的", "abc12", "x"]}


def test_against_all_cuts(spark):
    rnd = random.Random(4)
    letters = "天地人日月"
    freq = {"".join(rnd.choices(letters[:4], k=rnd.randrange(1, 4))): rnd.choice([1, 2, 2, 50]) for _ in range(18)}
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(1, 11))) for _ in range(60)]
    total = sum(freq.values())
    cost = {w: round(1000 * math.log(total / f)) for w, f in freq.items()}
    got = tokens(spark, texts, freq)
    for i, t in enumerate(texts):
        assert got[i] == brute(t, cost, max(cost.values()) + 1000), t


def test_edges(spark):
    assert tokens(spark, [None, "", " ,;", "天地", "A天b"], {}) == {0: [], 1: [], 2: [], 3: ["天", "地"], 4: ["a", "天", "b"]}
    assert tokens(spark, ["天" * 3000], {"天天": 5})[0] == ["天天"] * 1500
