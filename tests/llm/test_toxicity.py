import math
import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom.llm import toxicity


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    docs, labels = [], []
    for i in range(700):
        text = [rng.choice(words) for _ in range(rng.randint(5, 400))]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["Vileword", "nastor" + rng.choice("xyz"), "nastor" + rng.choice(["en", "ly"])]))
        if junk:
            text += ["&&&", "buynow"]
        docs.append((i, " ".join(text)))
        if i < 500:
            labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edge_rows(frame, corpus):
    docs, labels = corpus
    edge = [(1000, None), (1001, ""), (None, docs[5][1]), (1002, docs[6][1]), (1002, docs[6][1]), (1003, "calm " * 50_000 + "vileword"), (1004, "nastorish people")]
    frame_docs = frame([(i, t, 9) for i, t in docs + edge], "doc_id BIGINT, text STRING, toxic INT")
    frame_labels = frame(labels + [(0, 1, 1), (None, 1, 1), (1, None, 0), (2, 1, None), (9999, 1, 1)], "doc_id BIGINT, quality INT, toxic INT")
    out = toxicity.judge(frame_docs, frame_labels).collect()
    assert len(out) == len(docs) + len(edge)
    held = [r for r in out if r.doc_id is not None and 500 <= r.doc_id < 700]
    assert sum(r.toxic == (r.doc_id % 5 == 0) for r in held) >= 0.98 * len(held)
    assert not any(r.toxic for r in held if r.doc_id % 5)
    assert sum((r.p_low_quality > 0.5) == (r.doc_id % 7 == 0) for r in held) >= 0.95 * len(held)
    by_id = {r.doc_id: r for r in out}
    assert not by_id[1000].toxic and not by_id[1001].toxic and not by_id[1002].toxic and by_id[1004].toxic and by_id[None].toxic
    kept = toxicity.remove_toxic(frame_docs, frame_labels)
    assert kept.columns == ["doc_id", "text", "toxic"]
    assert kept.filter("doc_id IN (1000, 1001, 1002)").count() == 4 and kept.filter("toxic <> 9").isEmpty()


def test_no_labels_and_no_documents(frame, spark):
    docs = frame([(1, "a"), (2, None)], "doc_id BIGINT, text STRING")
    empty = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    assert {(r.p_toxic, r.toxic) for r in toxicity.judge(docs, empty).collect()} == {(0.0, False)}
    assert toxicity.judge(docs.limit(0), empty).count() == 0
    one_class = frame([(1, 1, 0)], "doc_id BIGINT, quality INT, toxic INT")
    assert not any(r.toxic for r in toxicity.judge(docs, one_class).collect())


def test_training_rows_are_bounded(frame):
    docs = frame([(i, "w") for i in range(4000)], "doc_id BIGINT, text STRING")
    labels = frame([(i, 1, i % 2) for i in range(4000)], "doc_id BIGINT, quality INT, toxic INT")
    n = toxicity.training_rows(docs, labels, toxicity.categories_of_labels(), rows=500).count()
    assert 350 < n < 650
    assert toxicity.training_rows(docs, labels, {"toxic": F.col("toxic")}, rows=10_000).count() == 4000


def test_sample_of_very_many_labels_and_an_empty_sample(frame, monkeypatch):
    for total in (24_000, 7_000_000_000, 24_000_000_000, 10**15):
        share = (toxicity.sample_below(12_000, total) + 2**63) / 2**64
        assert abs(share * total / 12_000 - 1) < 1e-3
    assert toxicity.sample_below(12_000, 12_000) is None
    docs = frame([(1, "a"), (2, "b")], "doc_id BIGINT, text STRING")
    labels = frame([(1, 1, 0), (2, 1, 1)], "doc_id BIGINT, quality INT, toxic INT")
    drawn = toxicity.training_rows
    monkeypatch.setattr(toxicity, "training_rows", lambda *a: drawn(*a).limit(0))
    with pytest.raises(ValueError):
        toxicity.judge(docs, labels)


def test_labels_that_disagree_and_rows_that_share_an_id(frame):
    docs = frame([(1, f"text {i}") for i in range(400)] + [(2, None), (3, "c"), (3, "c")], "doc_id BIGINT, text STRING")
    labels = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (2, 1, 0), (3, 1, 0), (3, 1, 0)]
    taught = []
    for given in (labels, labels[::-1]):
        rows = toxicity.training_rows(docs, frame(given, "doc_id BIGINT, quality INT, toxic INT"), toxicity.categories_of_labels())
        taught.append(sorted((sorted(r.terms), r.is_low_quality, r.is_toxic) for r in rows.collect()))
    assert taught[0] == taught[1] and len(taught[0]) == 3
    assert [t[1:] for t in taught[0] if not t[0]] == [(0.0, 1.0)]
    assert [t[1:] for t in taught[0] if "c" in t[0]] == [(0.0, 0.0)]
    assert [t[1:] for t in taught[0] if "text" in t[0]] == [(1.0, 0.0)]


def test_labels_of_a_fold_have_no_part_in_its_probabilities(frame, corpus):
    docs, labels = corpus
    categories = ["low_quality", "toxic"]
    given = toxicity.training_rows(
        frame(docs, "doc_id BIGINT, text STRING"), frame(labels, "doc_id BIGINT, quality INT, toxic INT"), toxicity.categories_of_labels(),
    ).withColumnRenamed("terms", "_terms_text")
    turned = given.withColumns({f"is_{c}": F.when(F.col("fold") == 1, 1 - F.col(f"is_{c}")).otherwise(F.col(f"is_{c}")) for c in categories})
    found = []
    for rows in (given, turned):
        out = toxicity.out_of_fold(rows.coalesce(1), "low_quality", categories, [])
        found.append({tuple(sorted(r._terms_text)): (r.fold, r.p_low_quality) for r in out.collect()})
    assert len(found[0]) == len(labels)
    gap = {f: max(abs(p - found[1][k][1]) for k, (g, p) in found[0].items() if g == f) for f in range(3)}
    assert gap[1] < 1e-9 < gap[0] and gap[2] > 1e-9
    alone = toxicity.out_of_fold(given.filter("fold = 2"), "low_quality", categories, []).select("p_low_quality").distinct().collect()
    assert [r[0] for r in alone] == [0.5]


def test_scores_equal_a_plain_computation_of_the_chain(frame, corpus):
    docs, labels = corpus
    frame_docs = frame(docs, "doc_id BIGINT, text STRING")
    categories = toxicity.categories_of_labels()
    training = toxicity.training_rows(frame_docs, frame(labels, "doc_id BIGINT, quality INT, toxic INT"), categories)
    chain = toxicity.fit_chain(training, list(categories))
    terms = chain.terms.vocabulary

    def plain(text):
        words = {w for w in re.split(r"[^\w]+|_", text.lower()) if w}
        known = words | {"^" + w[:toxicity.PREFIX] for w in words}
        values, out = [float(t in known) for t in terms], []
        for link in chain.links:
            z = link.intercept + sum(w * x for w, x in zip(link.coefficients.toArray(), values + out))
            out.append(1 / (1 + math.exp(-z)))
        return out

    scored = toxicity.score(frame_docs, chain, list(categories)).collect()
    assert len(scored) == len(docs)
    for r in scored:
        assert [r.p_low_quality, r.p_toxic] == pytest.approx(plain(r.text), abs=1e-9)
