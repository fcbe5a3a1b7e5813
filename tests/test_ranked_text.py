import random
import re

from pyspark.sql import functions as F

from heronry.operators import ranked_text


def stem(w):
    if w.endswith("ies") and not w.endswith(("eies", "aies")):
        return w[:-3] + "y"
    if w.endswith("es") and not w.endswith(("aes", "ees", "oes")):
        return w[:-1]
    return w[:-1] if w.endswith("s") and not w.endswith(("us", "ss")) else w


def words(text):
    return [stem(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]


def brute(queries, docs):
    """Scores by trying every stretch of every text: it counts if it holds all terms and none within it does."""
    out = {}
    for q, terms in queries:
        for i, a, b in docs:
            placed = [(k, w, 1.0) for k, w in enumerate(words(a))] + [(len(words(a)) + k, w, 0.4) for k, w in enumerate(words(b))]
            own = [p for p in placed if p[1] in terms]
            whole = [(s, e) for s in range(len(own)) for e in range(s, len(own)) if {p[1] for p in own[s : e + 1]} == set(terms)]
            least = [(s, e) for s, e in whole if not any((x, y) != (s, e) and s <= x and y <= e for x, y in whole)]
            score = 0
            for s, e in least:
                n = e - s + 1
                score += n / sum(1 / p[2] for p in own[s : e + 1]) / (1 + own[e][0] - own[s][0] - (n - 1))
            if least:
                out[q, i] = round(score, 6)
    return out


def test_covers(spark):
    rng = random.Random(9)
    some = ["cat", "cats", "dog", "flies", "fly", "the", "bus", "boxes", "über", "x1", "of"]
    docs = [(i, " ".join(rng.choices(some, k=rng.randint(0, 5))) or None, ", ".join(rng.choices(some, k=rng.randint(0, 25))) if i % 9 else None) for i in range(150)]
    queries = [(q, list(dict.fromkeys(stem(w) for w in rng.sample(some, rng.randint(1, 4))))) for q in range(25)]
    corpus = spark.createDataFrame(docs, "item_id int, described string, content string")
    asked = spark.createDataFrame([*queries, (99, [])], "query_id int, terms array<string>")
    got = {(r.query_id, r.item_id): r.raw for r in ranked_text.search(asked, corpus, 1000).collect()}
    assert got == brute(queries, docs)
    first = [r.item_id for r in ranked_text.search(asked.where("query_id = 3"), corpus, 5).orderBy("rank").collect()]
    assert first == [i for (q, i), _ in sorted(brute(queries, docs).items(), key=lambda kv: (-kv[1], kv[0][1])) if q == 3][:5]


def test_terms(spark):
    text = "The CATS of cities; buses, classes and a bus's Über-class"
    got = spark.createDataFrame([(text,)], "t string").select(ranked_text.terms(F.col("t")).alias("t")).first().t
    assert got == list(dict.fromkeys(w for w in words(text) if w not in ranked_text.STOP))
