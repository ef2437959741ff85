from collections import Counter

import numpy as np

import corpus_pipeline
from panelwright.llm import classifier, decontamination, secrets, simhash
from panelwright.llm.mixing import mix

from .test_simhash import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    words = [f"word{i}" for i in range(500)]
    text = lambda i, n=80: " ".join(words[(i * 37 + j * j * (i + 3)) % 500] for j in range(n))
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, text(i), "en", "s9", 1) for i in range(5)]  # copies
    rows += [(200 + i, text(i + 300) + " vile nasty", "en", "s0", 1) for i in range(20)]  # toxic
    rows += [(300, text(400) + " " + text(900, 30), "en", "s1", 1)]  # holds the benchmark item
    rows += [(301, text(401) + " token = 'abcdef123456'", "en", "s1", 1), (None, text(402), "en", None, 1), (302, None, "en", "s1", None)]
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 1, 1) for i in range(20)]
    return rows, labels, [(1, text(900, 30))]


def contaminated(item, text, s=decontamination.CORPUS):
    """Whether some probe of the item lies within its edits anywhere in text (Sellers)."""
    data, along = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for b in {*range(0, max(1, len(item) - s.probe + 1), s.stride), max(0, len(item) - s.probe)}:
        probe = item[b : b + s.probe]
        row = np.zeros(len(text) + 1, np.int64)
        for i, a in enumerate(probe, 1):
            new = np.concatenate(([i], np.minimum(row[:-1] + (data != a), row[1:] + 1)))
            row = np.minimum.accumulate(new - along) + along
        if row.min() <= s.budget(len(probe)):
            return True
    return False


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels, benchmark = corpus()
    for name, data, schema in (("documents", rows, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    model = classifier.labelled_model(spark, str(tmp_path))

    def good(text):
        index, value = classifier.features((text or "").encode())
        score = classifier.np.array([float(classifier.np.dot(model.weights[index].astype(float), value))])
        return classifier._tails(score, model.thresholds)[0, -1] >= 0.5

    left = [r for r in rows if good(r[1])]
    assert not {r[0] for r in left} & set(range(200, 220)) and {r[0] for r in left} >= set(range(60))
    component = {k: c for k, _, c in brute([(r[0], r[1]) for r in left])}
    left = [r for r in left if r[0] is None or component[r[0]] == r[0]]
    assert not {r[0] for r in left} & set(range(100, 105))
    item = decontamination.normalised(benchmark[0][1].encode())
    left = [r for r in left if not contaminated(item, decontamination.normalised((r[1] or "").encode()))]
    assert 300 not in {r[0] for r in left}
    want = Counter()
    for k, text, lang, source, n in left:
        spans = secrets.find_secrets([(text or "").encode()])[0]
        new = secrets.blank(text, spans) if spans else text
        want[k, new, lang, source, n if new == text else len(new)] += 1
    assert any("[assign]" in (t or "") for _, t, *_ in want)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(map(tuple, found.select(found.columns[:5]).collect())) == want
    again = mix(spark.createDataFrame(sorted(want, key=str), DOCS)).select("doc_id", "mix_position").collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found.select("doc_id", "mix_position").collect()), key=str)


def test_empty_documents(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and simhash.op10_simhash(spark, str(tmp_path)).count() == 0
