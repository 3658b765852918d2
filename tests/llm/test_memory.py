"""What the quality rules keep in a Python worker."""

from collections import Counter

import pyarrow as pa

from paperweave.llm import quality


def test_references_start_no_further_python_workers(spark, docs, empty, monkeypatch):
    def fail(*_):
        raise AssertionError("rows of Python objects run in Python workers of their own")

    plain = docs.repartition(1).collect()
    monkeypatch.setattr(quality, "REFERENCE_WORDS", 10)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", fail)
    words = {lang: sum(len((r["text"] or "").split()) for r in plain if r["lang"] == lang) for lang in ("en", "de")}
    assert quality.references(docs).langs == sorted(words, key=lambda x: -words[x])
    assert quality.references(empty).langs == []


def test_texts_are_worked_on_in_small_parts(monkeypatch):
    sizes, plain = [], quality.Texts

    class Seen(plain):
        def __init__(self, column):
            super().__init__(column)
            sizes.append(len(self.bytes))

    monkeypatch.setattr(quality, "Texts", Seen)
    texts = [f"word{i % 97} and some more of it {i}" * 20 for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en", "de"] * 1000)], names=["text", "lang"])
    list(quality._count(iter([batch])))
    assert max(sizes) <= 300_000 < sum(sizes)


def test_counts_do_not_depend_on_parts(monkeypatch):
    texts = [" ".join(f"w{(i * k) % 1009}" for k in range(1, 200)) for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en", "de", None] * 200)], names=["text", "lang"])

    def counted():
        found = Counter()
        for b in quality._count(iter([batch])):
            for r in b.to_pylist():
                found[r["lang"], r["kind"], r["key"]] += r["n"]
        return found

    whole = counted()
    monkeypatch.setattr(quality, "BATCH", 3000)
    assert counted() == whole
    monkeypatch.setattr(quality, "HELD", 1500)
    assert counted() == whole
