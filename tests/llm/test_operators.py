"""The ten operators: edge cases, brute-force versions, round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import uuid

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, html_text, language, mixing, near_dedup, neighbours, quality, subwords, token_counts, toxicity
from tessera.llm.common import shared_dir
from tessera.llm.components import components
from tessera.llm.exact_dedup import DigestIndex, exact_duplicates
from tessera.llm.queries import BPE_TOKENIZER, COUNT_TOKENIZER, ORACLES, QUERIES
from tests.conftest import SF, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size int, kept string"


def docs(spark, *texts, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", (sources or {}).get(i), 0, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = rows_of(QUERIES[name](spark, SF).toPandas())
    assert got == rows_of(duck.execute(ORACLES[name]).df())


def test_html_main_text():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Top</header><nav><a>Home</a></nav>
    <div class="cookie-notice">Cookies!</div><article><h1>Head &amp; tail</h1><p>One<b>two</b>
    three<br>four<p>Five &lt;six&gt;<form><label>Mail</label></form><aside>See also</aside></article>
    <section id="comments"><p>First!</p></section><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == "Head & tail\n\nOnetwo three four\n\nFive <six>"
    plain = "<nav><a>Home</a><a>News</a></nav><div><p>" + "Long text here. " * 9 + "</p><p>And more of the same text.</p></div><footer>(c)</footer>"
    assert html_text.main_text(plain) == ("Long text here. " * 9).strip() + "\n\nAnd more of the same text."
    assert html_text.main_text("") == "" and html_text.main_text("<p>") == ""


def test_html_edge_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<article><p>Hi"), (3, "u", "<article><p>Hi")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(rows).collect())
    assert found == [(1, "", 0), (2, "", 0), (3, "Hi", 2), (3, "Hi", 2)]
    assert html_text.extract(rows.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark, real):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(COUNT_TOKENIZER)
    tool = Tokenizer.from_file(path)
    odd = docs(spark, None, "", "<|endoftext|> a\x1c b", "x " * 3000, "a" * 9000, "日本語。" * 2000, "  \n\n tail  ")
    both = real.select("doc_id", "text").union(odd.select("doc_id", "text"))
    # small chunks, so that many documents are spliced
    for chunk in (400, 32_768):
        got = token_counts.token_counts(both, path, chunk=chunk).collect()
        want = {(r.doc_id, r.text): len(tool.encode(r.text or "", add_special_tokens=False)) for r in both.collect()}
        assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((k[0], n) for k, n in want.items())
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_resynchronisation_widens(spark):
    tool = token_counts.Counter(public_tokenizers.path(COUNT_TOKENIZER))
    text = "word " * 50 + "b" * 700 + " end of it " * 40
    assert tool.resynchronised(text, 60, 8) == len(tool.tokenizer.encode(text, add_special_tokens=False))


def brute_near(texts, width, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def test_near_dedup_equals_brute_force(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "One", "one", "a b", "A  b", "c d e f"]
    for _ in range(6):  # groups of copies with few to many edits, in chains
        base = [draw.choice(words) for _ in range(draw.randint(30, 120))]
        for _ in range(25):
            copy = list(base)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    passage = " ".join(draw.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(draw.choice(words) for _ in range(40)) for _ in range(30)]
    texts += texts[20:40]
    found = near_dedup.near_duplicates(docs(spark, *texts), 4, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_near(texts, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert near_dedup.near_duplicates(docs(spark, "x").limit(0)).count() == 0


def test_near_dedup_keys(spark):
    """Null and repeated ids, and a text long enough for several strips."""
    long = [f"w{i % 4000}x{i // 4000}" for i in range(30_000)]
    near = list(long)
    near[5] = "other"
    rows = [(3, "a b c d e f g"), (7, "A b c d e f  g"), (7, "something else entirely, not near"), (None, "a b c d e f g"), (None, "on its own here"), (None, "on its own here"), (9, " ".join(long)), (8, " ".join(near)), (4, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("clash"))
    found = near_dedup.near_duplicates(table).collect()
    got = sorted((str(r.doc_id), str(r.component_id), r.kept_row) for r in found)
    assert got == sorted([("3", "3", True), ("7", "3", False), ("7", "7", True), ("None", "3", False), ("None", "None", True), ("None", "None", False), ("9", "8", False), ("8", "8", True), ("4", "4", True)])


def test_prefix_pairs_of_a_common_passage(spark):
    """Documents that share most of their text, yet less than the bound, and some that share more."""
    draw = random.Random(8)
    passage = [f"p{i}" for i in range(85)]
    texts = []
    for i in range(120):
        own = [f"o{i}x{j}" for j in range(15 if i % 10 else 3)]
        at = draw.randrange(len(passage))
        texts.append(" ".join(passage[:at] + own + passage[at:]))
    found = near_dedup.near_duplicates(docs(spark, *texts), 4, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_near(texts, 4, 80)


def test_components_of_a_chain(spark):
    links = spark.range(1, 40).selectExpr("id as a", "id + 1 as b")
    assert {(r.id, r.component) for r in components(links).collect()} == {(i, 1) for i in range(1, 41)}
    assert components(links.limit(0)).count() == 0


@pytest.mark.parametrize("op", ["toxicity", "quality"])
def test_scores_on_edge_tables(spark, real, op):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    run = toxicity.toxicity if op == "toxicity" else quality.quality
    odd = real.union(docs(spark, None, "", "...", "w " * 50_000).select(real.columns)).withColumn("score", F.lit("clash"))
    found = run(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
    assert {r.score for r in run(odd, labels.limit(0)).collect()} == {0.0}
    assert run(odd.limit(0), labels).count() == 0


def test_toxicity_learns_ngrams():
    draw = random.Random(2)
    plain = ["lorem", "ipsum", "dolor", "amet", "velit", "magna", "porta", "nulla"]
    texts, labels = [], []
    for i in range(600):
        words = [draw.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            words[draw.randrange(60)] = draw.choice(["grumbleton", "grumbletom", "grumbleto"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    scorer = toxicity.Scorer(toxicity.train(texts, np.array(labels)))
    unseen = " ".join(plain * 7 + ["grumbletonn"])
    assert scorer.scores([unseen])[0] > 0.5 > scorer.scores([" ".join(plain * 7)])[0]


@pytest.mark.parametrize("texts, labels", [(["a b"], [1]), (["", ""], [0, 1]), (["one two", "three four"], [0, 1]), ([], [])])
def test_toxicity_of_few_rows(texts, labels):
    scorer = toxicity.Scorer(toxicity.train(texts, np.array(labels)))
    found = scorer.scores(["", "a b", "one", "x " * 1000])
    assert len(found) == 4 and ((found >= 0) & (found <= 1)).all()


def brute_toxicity(model, text):
    """The score of one text from its n-grams, one after the other."""
    words = set(re.findall(r"\w+", text.lower()))
    if not words:
        return model["prior"]
    total = 0.0
    for word in words:
        grams, _ = subwords.hashed_ngrams([word], toxicity.SIZES, toxicity.BUCKETS, whole=True)
        total += sum(float(model["bucket"][g]) for g in grams) / len(grams)
    return 1 / (1 + np.exp(-(total / len(words) ** 0.5 + model["bias"])))


def test_toxicity_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.fit(rows, labels, F.expr("pmod(crc32(cast(doc_id as string)), 5) != 0"))
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    found = QUERIES["op4_toxicity"](spark, path)
    for r in found.limit(40).collect():
        assert r.score == pytest.approx(brute_toxicity(model, texts[r.doc_id]), abs=1e-6)
    held = [(r.predicted, r.toxic) for r in found.join(labels, "doc_id").filter("held_out and toxic is not null").collect()]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_repeated_ids_and_labels_train_once(spark, real):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for op in (toxicity, quality):
        plain = op.fit(real, labels)
        again = op.fit(real.union(real), labels.union(labels))
        probe = ["some text, 1 2 3", ""]
        if op is toxicity:
            assert np.allclose(op.Scorer(plain).scores(probe), op.Scorer(again).scores(probe))
        else:
            x = np.array([quality.statistics(t) for t in probe])
            assert np.allclose(op.scores(plain, x), op.scores(again, x))


def brute_quality(x, y, at):
    """Log-densities of both classes by plain solves and determinants."""
    z, q = (x - x.mean(0)) / (x.std(0) + 1e-6), (at - x.mean(0)) / (x.std(0) + 1e-6)
    pooled = sum(np.cov(z[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / len(y)
    out = []
    for k in (0, 1):
        own = z[y == k]
        c = (1 - quality.TO_POOLED) * np.cov(own.T, bias=True) + quality.TO_POOLED * pooled
        c = (1 - quality.TO_DIAGONAL) * c + quality.TO_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        d = q - own.mean(0)
        out.append(np.log(len(own) / len(y)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.solve(c, d))
    return 1 / (1 + np.exp(out[0] - out[1]))


def test_quality_equals_brute_force(real, spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(quality.statistics(r.text or ""), labels[r.doc_id]) for r in real.collect() if labels.get(r.doc_id) is not None]
    x, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    got = quality.scores(quality.train(x, y), x[:25])
    assert np.allclose(got, [brute_quality(x, y, at) for at in x[:25]], atol=1e-8)


def test_language_equals_brute_force(real):
    rows = [r for r in real.collect() if r.text and r.lang]
    model = language.train([r.text for r in rows[:120]], [r.lang for r in rows[:120]])
    got = language.Predictor(model).predict([r.text for r in rows[120:150]])[0]
    for r, lang in zip(rows[120:150], got):
        x = language._features([r.text])[0].astype(float)
        margin = {(of, a, b): x @ model["weights"][:, k] + model["biases"][k] for k, (of, a, b) in enumerate(model["duels"])}

        def winner(level, names):
            won = {n: [0, 0.0] for n in names}
            for (of, a, b), m in margin.items():
                if of == level:
                    won[a if m > 0 else b][0] += 1
                    won[a][1] += m
                    won[b][1] -= m
            return min(names, key=lambda n: (-won[n][0], -won[n][1], n))

        kind = winner("", sorted(model["members"]))
        assert lang == winner(kind, model["members"][kind])


def test_quality_held_out(spark):
    path = "/root/testdata/sf0.01"
    found = QUERIES["op6_quality"](spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out")
    assert found.filter("predicted = quality").count() >= 0.95 * found.count()


def test_language_held_out(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op7_language"](spark, path).join(rows, "doc_id").filter("held_out")
    assert found.filter("lang_pred = lang").count() >= 0.97 * found.count()


def test_language_edge_rows(spark, real):
    odd = real.union(docs(spark, None, "", "123 !?", "é").select(real.columns)).withColumn("lang_pred", F.lit("clash"))
    found = language.languages(odd).collect()
    assert len(found) == odd.count() and sum(r.lang_pred == "und" for r in found) == 3
    assert {r.lang_pred for r in language.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.languages(odd.limit(0)).count() == 0


def test_exact_dedup_over_batches(spark):
    new_index = lambda: DigestIndex(spark, f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}", 4)
    index = new_index()
    first = index.add(docs(spark, "a b", "a  b", None, "", " ", "c"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in first.collect()}
    assert got == {0: (0, 2, True), 1: (0, 2, False), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 1, True), 5: (5, 1, True)}
    again = {r.doc_id: (r.keep_id, r.kept) for r in index.add(docs(spark, "new", "a\tb", "c")).collect()}
    assert again == {0: (0, True), 1: (0, False), 2: (5, False)}
    assert index.table().count() == 5
    twice = docs(spark, "z").union(docs(spark, "z"))
    assert new_index().add(twice).filter("kept").count() == 1
    assert new_index().add(twice.limit(0)).count() == 0


def test_digest_index_outlives_its_session(spark):
    """Another session knows nothing of the table but its folder; a failed append leaves no trace."""
    path = f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
    first = DigestIndex(spark, path, 4)
    assert first.add(docs(spark, "a", "b")).filter("kept").count() == 2
    spark.sql(f"DROP TABLE {first.name}")  # external: the files stay, the catalog forgets them
    assert not spark.catalog.tableExists(first.name)
    second = DigestIndex(spark, path, 99)
    assert second.buckets == 4
    bad = docs(spark, "c", "d").withColumn("doc_id", F.when(F.col("doc_id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("doc_id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        second.add(bad)
    with pytest.raises(Exception, match="lost"):
        second._append(spark.range(100).selectExpr("cast(id as string) as text_sha256", "if(id = 77, raise_error('lost'), id) as keep_id", "'x' as keep_batch", "id as keep_key"))
    third = DigestIndex(spark, path)
    assert third.table().count() == 2
    got = {r.doc_id: (r.keep_id, r.kept) for r in third.add(docs(spark, "b", "c", "d")).collect()}
    assert got == {0: (1, False), 1: (1, True), 2: (2, True)}
    joined = third.table().select("text_sha256").hint("merge").join(spark.range(5).selectExpr("cast(id as string) as text_sha256").repartition(4, "text_sha256"), "text_sha256")
    assert "SelectedBucketsCount: 4 out of 4" in joined._jdf.queryExecution().toString()
    third.drop()
    assert not spark.catalog.tableExists(first.name)


def test_exact_dedup_of_a_table_in_batches(spark):
    long = "very long " * 200_000
    rows = [(9, "a"), (None, "a"), (None, "b"), (3, "a"), (3, "a"), (5, long), (1, long + " "), (7, None), (None, None), (2, "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row_key", "kept", "keep_id", "text_sha256")})
    tables = {t.name for t in spark.catalog.listTables()}
    for batches in (1, 3, 7):
        found = exact_duplicates(table, batches=batches)
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found.collect())
        want = [("1", "1", 2), ("2", "2", 1), ("3", "3", 4), ("3", "3", 4), ("5", "1", 2), ("7", "7", 2), ("9", "3", 4), ("None", "3", 4), ("None", "7", 2), ("None", "None", 1)]
        assert got == want
        assert found.filter("kept").count() == 5
    assert exact_duplicates(table.limit(0)).count() == 0
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_mixing_edges(spark):
    rows = docs(spark, "a b c", None, "d", "", "e f", sources={0: "x", 2: "y"})
    found = mixing.mix(rows).collect()
    assert len(found) == 5 and all(0 <= r.taken <= 2 * r.size for r in found)
    totals = {}
    for r in found:
        totals.setdefault((r.source_size, r.target), 0)
        totals[r.source_size, r.target] += r.taken
    assert all(abs(t - target) <= 0.5 for (_, target), t in totals.items())
    assert abs(sum(t for _, t in totals) - 1.5 * 6) < 1e-9
    assert mixing.mix(rows.limit(0)).count() == 0


def test_bpe_equals_the_library(spark, real):
    import tiktoken

    path = public_tokenizers.path(BPE_TOKENIZER)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = docs(spark, None, "", "aaaa" * 999, "<|endoftext|>", "a\x1c\x1d b\u0085 \xa0 c", "日本語 😀\n\n  x", "'S it's").select("doc_id", "text")
    rows = real.select("doc_id", "text").union(odd)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(rows, path, public_tokenizers.PATTERN).collect())
    want = []
    for r in rows.collect():
        ids = tool.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    decoded = bpe.decode(bpe.encode(rows.withColumn("ids", F.lit(1)), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert decoded.filter(F.coalesce("text", F.lit("")).cast("binary") != F.col("decoded")).count() == 0


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.0, 0.0], None, [nan, 1.0], [inf, 1.0], [0.5, None], [0.0, 2.0], [3.0, 3.0], [-1.0, 0.0]]
    rows = spark.createDataFrame([(i * 10, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score string")
    found = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.neighbours(rows, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 10), (0, 2, 80), (0, 3, 70), (0, 4, 90)]
    assert neighbours.neighbours(rows.limit(0), F.col("id") % 50 == 0).count() == 0


def test_neighbours_of_tiny_huge_and_ragged_vectors(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(600, 12)).astype(np.float32)
    vectors[::7] *= np.float32(1e-30)
    vectors[1::7] *= np.float32(1e30)
    rows = [(i, [float(x) for x in v[: 12 - (i % 3)]]) for i, v in enumerate(vectors)]
    rows.append((50, rows[51][1]))  # an id with two vectors
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.neighbours(table, F.col("id") % 50 == 0, rerank=40).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    padded = np.zeros((len(rows), 12))
    for i, (_, v) in enumerate(rows):
        padded[i, : len(v)] = np.asarray(v, dtype=np.float32)
    padded /= np.abs(padded).max(1, keepdims=True)
    padded /= np.linalg.norm(padded, axis=1, keepdims=True)
    hits = total = 0
    for q in {i for i, _ in rows if i % 50 == 0}:
        best = {}
        for i, (a, _) in enumerate(rows):
            if a == q:
                for j, (b, _) in enumerate(rows):
                    if b != q:
                        best[b] = max(best.get(b, -2), float(padded[i] @ padded[j]))
        want = sorted(best, key=lambda b: (-best[b], b))[:5]
        assert sorted(x for x, _, _ in found[q]) == [1, 2, 3, 4, 5]
        assert all(abs(score - best[b]) < 1e-9 for _, b, score in found[q])
        hits += len(set(want) & {b for _, b, _ in found[q]})
        total += 5
    assert hits >= 0.9 * total


def test_neighbours_recall(spark, duck):
    path = "/root/testdata/sf0.1"
    found = {(r.query_id, r.vec_id) for r in QUERIES["op10_neighbours"](spark, path).collect()}
    want = duck.execute(ORACLES["op10_neighbours"].replace("from embeddings", f"from '{path}/embeddings.parquet'")).fetchall()
    assert sum((q, v) in found for q, _, v, _ in want) >= 0.9 * len(want)


def test_neighbours_recall_in_one_large_group_and_of_wide_vectors(spark):
    draw = np.random.default_rng(1)
    group = draw.normal(size=(1, 64)) + 1e-3 * draw.normal(size=(2_000, 64))
    for rows in (np.vstack([draw.normal(size=(2_000, 64)), group]), draw.normal(size=(4_000, 256))):
        rows = rows.astype(np.float32).astype(np.float64)
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
        found = {(r.query_id, r.vec_id) for r in neighbours.neighbours(table, F.col("id") % 50 == 0).collect()}
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        asked = np.arange(0, len(rows), 50)
        cosines = rows[asked] @ rows.T
        cosines[np.arange(len(asked)), asked] = -2
        want = {(int(q), int(v)) for q, best in zip(asked, np.argsort(-cosines, axis=1)[:, :5]) for v in best}
        assert len(found & want) >= 0.99 * len(want)
