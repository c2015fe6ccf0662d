import itertools
from pathlib import Path

import corpus_pipeline
import numpy as np
from test_dedup import norm
from test_simhash import jaccard, plain_stays, shingles

from loomgrain.llm.common import materialise, scratch_root, table

SF = "/root/testdata/sf0.01"


def plain_words(text):
    return "".join(c.lower() if c.isascii() and c.isupper() else c if ord(c) >= 128 or c.isalnum() else " " for c in text).split()


def edit_distance(item, text):
    """Smallest number of word edits between the item and a passage of the text, by the full table."""
    number = {w: k for k, w in enumerate(item)}
    item, text = [number[w] for w in item], np.array([number.get(w, -1) for w in text])
    places = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, a in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (text != a))))
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def leaks(texts, items):
    own = [plain_words(x) for x in items]
    return [any(len(w) > 0 and edit_distance(w, plain_words(t)) <= len(w) // 5 for w in own) for t in texts]


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    benchmark = [r.text for r in table(spark, SF, "benchmark").collect()]
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        left = {r.doc_id for r in after}
        assert left <= {r.doc_id for r in before}
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            clean = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0}
            assert clean <= left and not any(labels[i].quality == 0 for i in left & set(labels))
        elif k == 1:
            best = {}
            for r in before:
                best[norm(r.text)] = max(r.doc_id, best.get(norm(r.text), -1))
            assert left == set(best.values())
        elif k == 2:  # five words and a similarity of 0.8
            before.sort(key=lambda r: r.doc_id)
            assert sorted(r.text for r in after) == sorted(before[n].text for n in plain_stays([(r.doc_id, r.text) for r in before]))
            own = {r.doc_id: shingles(r.text) for r in before}
            assert sum(not any(jaccard(own[i], own[j]) >= 0.8 for j in left) for i in own) <= 0.01 * len(own)  # linked through others
            missed = [1 for x, y in itertools.combinations(left, 2) if abs(len(own[x]) - len(own[y])) <= 0.2 * len(own[x]) and jaccard(own[x], own[y]) >= 0.8]
            assert len(missed) <= 1 and len(left) < len(before)
        elif k == 3:
            hit = leaks([r.text for r in before], benchmark)
            assert sorted(r.text for r in after) == sorted(r.text for r, h in zip(before, hit, strict=True) if not h) and any(hit)
        else:
            assert len(after) == len(before)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
    left = Path(scratch_root(spark).removeprefix("file:")).glob("stage-tables-*")
    assert not list(left)  # each stage's own tables went with it


def test_no_stage_loses_rows_for_their_identifiers(spark):
    """Null, repeated and shared identifiers: each clean text that the first stage keeps reaches the end once."""
    docs = table(spark, SF, "documents")
    clean = table(spark, SF, "labels").where("quality = 1 AND toxic = 0")
    some = [r.text for r in docs.join(clean, "doc_id").orderBy("doc_id").limit(60).collect()]
    benchmark = [r.text for r in table(spark, SF, "benchmark").collect()]
    item = benchmark[0]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in enumerate(some)]
    rows += [(None, item), (7, f"{some[5]} {item}"), (None, some[0].upper()), (7, some[1]), (None, None), (8, "")]
    odd = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = [r.text for r in odd.collect()]
        odd = materialise(stage(spark, odd, SF), f"test-{k}")
        after = [r.text for r in odd.collect()]
        if k == 1:
            assert sorted(map(norm, after)) == sorted({norm(t) for t in before})
        elif k == 2:
            own = [shingles(t) for t in after]
            assert all(any(jaccard(shingles(t), x) >= 0.8 for x in own) for t in before)
        elif k == 3:
            assert sorted(t or "" for t in after) == sorted(t or "" for t, h in zip(before, leaks([t or "" for t in before], benchmark), strict=True) if not h)
    assert len(after) > 40
    assert corpus_pipeline.mix(spark, odd, SF).count() == len(after)
