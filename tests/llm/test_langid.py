from pyspark.sql import functions as F

from cadenza.llm import langid
from cadenza.llm.queries import op7_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op7_language_id(spark, sf).join(docs, "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("hit"), "score").collect()
    assert len(got) > 100 and sum(r["hit"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "12 !", "en"), (5, "le la les", None), (None, "the the", None), (6, "", None), (6, "x" * 300000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as lang_pred")
    model = langid.learn(df)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(df, model).collect()]
    assert got[:6] == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "fr"), (None, "en")] and len(got) == 8
    assert langid.learn(df.limit(0)).predict("hello") == ("und", 0.0)
    kept = langid.keep_known(df, model, 0.0)
    assert kept.columns == df.columns and kept.count() == 5
    assert langid.identify(df.limit(0), model).count() == 0


def test_parts_of_long_texts_count_as_the_whole():
    f = langid.Features()
    text = "abcdefghij klmno" * 400
    whole, parts = f(text), f(text, part=100)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_temperature_is_inside_the_grid(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 400)
    apart = np.eye(3)[labels] * 9 + rng.normal(0, 0.5, (400, 3))  # all told right
    mixed = np.eye(3)[labels] * 2 + rng.normal(0, 2.0, (400, 3))
    for logits in (apart, mixed, apart / 100, mixed * 50):
        t = langid.temperature_of(logits, labels)
        assert 1 / 200 < t < 200
    p = np.exp(mixed / langid.temperature_of(mixed, labels))
    p = (p / p.sum(1, keepdims=True)).max(1)
    assert abs(p.mean() - (mixed.argmax(1) == labels).mean()) < 0.05  # calibrated
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert 1 / 200 < langid.learn(docs).temperature < 200


def test_the_sample_is_that_of_the_smallest_hashes(spark):
    """Copies of one text count once, and how rows are dealt out doesn't matter."""
    rows = [(f"{'the cat' if k % 2 else 'le chat'} number {k}", "en" if k % 2 else "fr") for k in range(400)] + [("the same text again", "en")] * 400
    df = spark.createDataFrame(rows, "text string, lang string")
    one, two = langid.learn(df.repartition(3), per_language=50), langid.learn(df.repartition(7), per_language=50)
    assert (one.weights == two.weights).all() and one.temperature == two.temperature


def test_a_language_of_few_texts_with_many_copies_is_learnt(spark):
    rows = [(f"the number {k} of the house and the garden in the town", "en") for k in range(3000)]
    few = ["el gato negro duerme sobre la mesa de la cocina", "los niños juegan en la calle con una pelota", "mañana vamos a comer pescado en el puerto"]
    texts = spark.createDataFrame(rows, "text string, lang string")
    for copies in (1, 2000, 20000):
        many = spark.range(copies).crossJoin(spark.createDataFrame([(t, "es") for t in few], "text string, lang string")).select("text", "lang")
        model = langid.learn(texts.unionAll(many))
        assert [model.predict(t)[0] for t in few] == ["es"] * 3, copies
        assert model.predict("the number 7 of the street")[0] == "en"


def test_predictions_by_plain_arithmetic(spark):
    """TF-IDF, weights, temperature and softmax of each document without vectors, from n-grams cut by hand."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    mask, bits = (1 << 32) - 1, model.features.size.bit_length() - 1

    def hashes(text):
        chars = [ord(c) for c in f" {text} ".lower()]
        for n in (1, 2, 3):
            for a in range(len(chars) - n + 1):
                h = chars[a] * 0x9E3779B1 & mask
                for c in chars[a + 1 : a + n]:
                    h = ((h ^ h >> 15) * 0x85EBCA6B + c) & mask
                yield (h * 0xC2B2AE35 & mask) >> (32 - bits)

    def predicted(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        tf = {}
        for k in hashes(text):
            tf[k] = tf.get(k, 0) + 1
        x = {k: math.log1p(n) * model.idf[k] for k, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [sum(v / norm * float(model.weights[k, j]) for k, v in x.items()) / model.temperature for j in range(len(model.languages))]
        p = [math.exp(a - max(z)) for a in z]
        return model.languages[p.index(max(p))], max(p) / sum(p)

    texts = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 3000}
    seen = 0
    for r in langid.identify(docs, model).collect():
        if r["doc_id"] in texts:
            lang, score = predicted(texts[r["doc_id"]])
            assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-5
            seen += 1
    assert seen > 100
