"""Many languages in op7's training."""

from tessera.llm import language


def test_every_language_is_trained(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_ROWS", 120)
    monkeypatch.setattr(language, "LEAST_ROWS", 2)
    taken = []
    monkeypatch.setattr(language, "fitted", lambda sample, *_: taken.extend(map(tuple, sample.select("lang", "doc_id").collect())))
    codes = [c for codes in language.FAMILIES.values() for c in codes.split()]
    rows = [(i, f"text {i}", codes[i % len(codes)]) for i in range(20 * len(codes))]
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10)
    counts = {c: sum(x == c for x, _ in taken) for c in codes}
    assert set(counts.values()) == {max(2, 120 // len(codes))}
