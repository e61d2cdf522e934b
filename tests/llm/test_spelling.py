import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cadenza.llm import spelling
from cadenza.llm.queries import op11_spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows, least_length=7, least_count=2):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def brute_near(words):
    """By deleted code points: a word's own, and those that it shares at the same place with another."""
    near, masks = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            d = w[:k] + w[k + 1 :]
            masks[k, d].add(w)
            if d in words:
                near[w].add(d)
                near[d].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(n):
    near = brute_near(n)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_by_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
        want = brute(brute_counts([tuple(r) for r in docs]))
        out = got(op11_spelling_variants(spark, f"/root/testdata/{sf}"))
        assert out == want
        assert sum(v[0] is not None for v in want.values()) >= 5


def test_words_of_every_shape(spark):
    """Short and long words, ends, repeats, letters of two bytes, shared halves, long shared prefixes."""
    words = {"", "a", "b", "ab", "ba", "aa", "aaa", "abc", "abd", "bc", "xabc", "abcx", "abxc", "äbc", "éè", "é", "aab", "abb", "aabb"}
    words |= {"a" * k for k in (300, 301, 302, 304)} | {"ab" * 200 + c for c in ("", "x", "y", "xy", "yx")} | {"x" + "ab" * 200, "ab" * 100 + "x" + "ab" * 100}
    words |= {"interna" + s for s in ("tional", "tionel", "tionals", "tonal", "l", "ls", "te")} | {"z" + "interna" + s for s in ("l", "tional")}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    near = brute_near(words)
    pairs = [tuple(r) for r in spelling.neighbours(df).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in near[a]}


def test_chain_of_forms_and_ties(spark):
    n = {"wordone": 1, "wordond": 100, "wordonf": 100, "wordondx": 1200, "wordondy": 10, "alone": 3}
    out = got(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert out == brute(n) and out["wordone"][:2] == ("wordond", "wordondx") and out["wordondy"][1] == "wordondx" and out["alone"] == (None, "alone", 3, 0, None)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "12 34 -- Ж"), (4, "abcdefg Abcdefg ABCDEFG"), (4, "abcdefg Abcdefg ABCDEFG"), (None, "abcdefgh abcdefgh"), (5, "qwertyu " * 30000), (6, "q" * 3000), (7, "q" * 3000), (8, "q" * 3001 + " " + "q" * 2999)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2 as run", "3 as node")
    assert got(spelling.spelling_variants(df)) == brute(brute_counts(rows))
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    assert spelling.spelling_variants(df.where(F.col("text").isNull())).count() == 0
