"""The corpus pipeline against a plain Python version of its stages."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keystrata.llm import langid
from keystrata.llm.sentencepiece_fst import default_model
from test_llm import DOCS, WORDS, brute_classes, brute_fill, brute_lines

sentencepiece = pytest.importorskip("sentencepiece")


def corpus():
    rng = random.Random(11)
    shared = "\n".join(" ".join(rng.choice(WORDS["en"]) + str(rng.randrange(9)) for _ in range(20)) for _ in range(4))
    rows = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        lines = [" ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefgh") for _ in range(rng.randint(3, 15))) for _ in range(rng.randint(1, 8))]
        text = "\n".join(lines)
        if i % 9 == 0:
            text += "\n" + shared
        if i % 7 == 3:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            if len(words) > 3:
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 31 == 5:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text, lang, rng.choice(["a", "a", "a", "b", "c", None]), len(text)))
    return rows + [(900, None, "en", "a", None), (901, "", None, "b", 0), (902, "12 34", "en", None, 5)]


def brute_mix(rows):
    strata = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    own = {s: [r for r in rows if r[3] == s] for s in strata}
    totals = [sum(size[r[0]] for r in own[s]) for s in strata]
    targets = brute_fill(totals, [[5, 2, 1][i % 3] for i in range(len(strata))])
    taken = {}
    for s, total, target in zip(strata, totals, targets, strict=True):
        whole = int((target + 1e-9) // total) if total else 0
        extra = target - whole * total
        rest = sorted(own[s], key=lambda r: (hashlib.md5(f"mix:{r[0]}".encode()).hexdigest(), r[0]))
        taken |= {r[0]: whole for r in rest}
        rest, open_ = [r for r in rest if size[r[0]]], extra
        # the fill, and passes over what it left: documents no larger than the gap, up to the first that does not fit
        left = rest
        for _ in range(1 + corpus_pipeline.REFILLS):
            run, fits = 0, []
            for r in left:
                run += size[r[0]]
                if run > open_ + 1e-9:
                    break
                fits.append(r)
            taken |= {r[0]: whole + 1 for r in fits}
            open_ -= sum(size[r[0]] for r in fits)
            left = [r for r in left if r not in fits and size[r[0]] <= open_ + 1e-9]
        rest = [r for r in rest if taken[r[0]] == whole]
        best = min(rest, key=lambda r: abs(size[r[0]] - open_), default=None)
        if best and abs(size[best[0]] - open_) < open_ - 1e-9:
            taken[best[0]] += 1
    return taken


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    samples = langid.training_samples(docs.where(~langid.held_out()))
    model = langid.Compressors({k: langid.letters(v).encode() for k, v in samples.items()})
    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1])) and model.best(r[1])[2] >= corpus_pipeline.MIN_MARGIN]
    assert 0.9 * 240 <= len(rows) <= 240
    cut = brute_lines(rows)
    assert any(cut[r[0]] != r[1] for r in rows)
    rows = [(r[0], cut[r[0]], *r[2:4], len(cut[r[0]])) for r in rows]
    classes = brute_classes(rows, 5, 80, 100)
    assert len({top for _, top in classes.values()}) < len(rows)
    rows = [r for r in rows if classes[r[0]][1] == r[0]]
    taken = brute_mix(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = Counter()
    for r in rows:
        want[(*r, tuple(library.encode(r[1])))] += taken[r[0]]
    got = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_repeated_rows_and_rows_without_an_id_stay_once(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:-1], x]) for x in ("a", "b")]
    rows = [(i, near[0], "en", "s", 1) for i in (4, 4, 3, 3)] + [(None, near[1], "en", "s", 1), (None, "x y z", "en", "s", 1), (5, "", "en", "s", 0)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "x y z"), (3, near[0]), (5, "")]


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame(corpus()[:20], DOCS).withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == corpus_pipeline.COLUMNS
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCS), "").count() == 0
