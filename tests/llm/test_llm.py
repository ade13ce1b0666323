"""Operators of keystrata.llm against brute force, round trips and their edge cases."""

import base64
import hashlib
import io
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import chat, langid, line_dedup, media, ngram_join, sharding, warc
from keystrata.llm.common import trimmed
from keystrata.llm.components import components
from keystrata.llm import exact_dedup as exact_dedup_module
from keystrata.llm.exact_dedup import SPARE_BITS, directory, exact_dedup
from keystrata.llm.mixing import mix, water_fill
from keystrata.llm.sentencepiece_fst import Model, Normaliser, Transducer, default_model, encode_texts
from keystrata.llm.sharding import interleave
from keystrata.operators import running

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Null, empty and blank texts, copies, null ids, sources and languages, and a long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \t\n", "en", None, 3),
    (4, "a b\tc", "en", "s", 5),
    (5, "abc ", "de", "t", 4),
    (6, "abc", "de", "t", 3),
    (None, "a  b  c  d", None, "s", 10),
    (8, "é日本🎉 ▁ <s>", "fr", "s", 12),
    (9, "wort " * 30000, "de", "t", 150000),
    (10, "eins\nzwei\ndrei\nvier\neins\nzwei\ndrei", "de", "u", 34),
    (11, "x\neins\nzwei\ndrei\ny", "de", "u", 19),
    (12, "\n\n\n\n\n", "de", "u", 5),
]


def docs(spark, rows=ODD):
    # extra columns whose names clash with those that operators add
    made = spark.createDataFrame(rows, DOCS)
    names = ("n", "h", "key", "size", "ids", "spans", "margin", "cell", "_doc", "_text", "_id", "_starts", "_K0", "_cell", "_salt", "digest", "sid")
    return made.withColumns({c: F.lit("x") for c in names})


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- media


def brute_means(image, height, width):
    """Area means by the share that every sample has in every cell."""

    def weights(n, parts):
        out = np.zeros((parts, n))
        for p in range(parts):
            for i in range(int(p * n / parts), min(n, int((p + 1) * n / parts) + 1)):
                out[p, i] = max(0, min(i + 1, (p + 1) * n / parts) - max(i, p * n / parts))
        return out / (n / parts)

    return weights(image.shape[0], height) @ image.astype(float) @ weights(image.shape[1], width).T


def test_payloads_are_stored_and_read_back(spark):
    got = by_id(media.text_as_media(docs(spark)))
    assert len(got) == len(ODD)
    for doc, text, *_ in ODD:
        data = (text or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        grey = np.frombuffer(padded, np.uint8).reshape(-1, 64)
        if zlib.crc32(padded) % 2:
            stored = media.encode_bmp(grey)
            assert stored[:2] == b"BM" and stored[-64:] == padded[:64]
        small = np.load(io.BytesIO(bytes(r.tile)))
        assert np.array_equal(small[:, :, 0], np.rint(brute_means(grey, 32, 32)))
        assert (r.tile_sha256, r.tile_sum) == (hashlib.sha256(r.tile).hexdigest(), small.sum())
        means = brute_means(grey, 8, 9)
        bits = "".join("1" if b - a > 1e-6 else "0" for row in means for a, b in zip(row, row[1:]))
        assert r.feature == f"{int(bits, 2):016x}"
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[1].feature == got[2].feature == "0" * 16
    assert {zlib.crc32(media.payload_of(t)[0]) % 2 for _, t, *_ in ODD} == {0, 1}
    assert media.text_as_media(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (9000, 7), (64, 64), (5, 200)])
def test_area_resize_is_the_mean_of_areas(shape):
    image = np.random.default_rng(1).integers(0, 256, (*shape, 2)).astype(np.uint8)
    got = media.area_resize(image, 4, 3, block=100)
    h, w = shape

    def weights(n, parts):
        out = np.zeros((parts, n))
        for p in range(parts):
            for i in range(n):
                out[p, i] = max(0, min(i + 1, (p + 1) * n / parts) - max(i, p * n / parts))
        return out / (n / parts)

    want = np.einsum("pi,ijc,qj->pqc", weights(h, 4), image.astype(float), weights(w, 3))
    assert np.allclose(got, want)


def test_decoders():
    grey = np.arange(15, dtype=np.uint8).reshape(3, 5)
    for data in (media.encode_pgm(grey), media.encode_bmp(grey), b"P2 # c\n5 3\n255\n" + b" ".join(b"%d" % v for v in range(15))):
        assert np.array_equal(media.decode(data)[:, :, 0], grey)
    assert media.decode(b"P4\n9 2\n" + bytes([0b10000000, 0x80, 0, 0])).reshape(2, 9).tolist() == [[0] + [255] * 7 + [0], [255] * 9]
    assert media.decode(b"P1 2 1\n1 0").tolist() == [[[0], [255]]]
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[[258]]]
    put = lambda v, n: v.to_bytes(n, "little")
    head = b"BM" + put(62, 4) + put(0, 4) + put(54, 4) + put(40, 4) + put(1, 4) + put(2, 4) + put(1, 2) + put(24, 2) + bytes(24)
    assert media.decode(head + b"\x03\x02\x01\0\x06\x05\x04\0").tolist() == [[[4, 5, 6]], [[1, 2, 3]]]


def test_samples_are_scaled_by_the_maximum():
    assert media.decode(b"P5\n2 1\n15\n\x0f\x07").ravel().tolist() == [255, 119]
    assert media.decode(b"P5\n1 1\n1023\n\x03\xff").ravel().tolist() == [65535]
    assert media.decode(b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n\1\2\3\4").tolist() == [[[1, 2, 3, 4]]]
    assert np.load(io.BytesIO(media.tile(media.decode(b"P5\n1 1\n1023\n\x03\xff"), 2))).ravel().tolist() == [255] * 4
    ints = lambda *v: b"".join(x.to_bytes(4, "little") for x in v)
    head = b"BM" + ints(70, 0, 66, 40, 1, 1) + b"\1\0\x20\0" + ints(3, 4, 0, 0, 0, 0)
    # red, green and blue from the lowest byte up
    assert media.decode(head + ints(0xFF, 0xFF00, 0xFF0000) + b"\xff\0\0\0").tolist() == [[[255, 0, 0]]]


@pytest.mark.parametrize("bad", [b"P2\n1 1\n255\n99999999999999999999999", b"P2\n1 1\n255\n300", b"P5\n1 1\n15\n\x10", b"P7\n", b"", b"P5", b"P5\n2 2\n255\n\x01", b"P9\n1 1\n", b"BM", b"P2\n0 1\n255\n", b"BM" + bytes(60)])
def test_broken_media_have_a_reason(bad):
    assert media.media_features(bad)[-1]


def test_media_columns(spark):
    grey = np.random.default_rng(2).integers(0, 256, (40, 50)).astype(np.uint8)
    rows = spark.createDataFrame([(1, bytearray(media.encode_bmp(grey))), (2, None), (3, bytearray(b"no"))], "doc_id bigint, media binary")
    got = by_id(media.media_columns(rows))
    assert (got[1].height, got[1].width, got[1].channels, got[1].error) == (40, 50, 1, None)
    small = np.load(io.BytesIO(bytes(got[1].tile)))
    assert small.shape == (32, 32, 1) and abs(small.mean() - grey.mean()) < 2
    assert got[2].error and got[3].error and media.media_columns(rows.limit(0)).count() == 0


# --- line dedup


def brute_lines(rows):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    for doc, text, *_ in order:
        if text is None:
            out[doc] = None
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if re.search(r"[^\x20\x09-\x0D]", "".join(w)) and seen.setdefault(w, (doc, i)) != (doc, i):
                gone |= {i, i + 1, i + 2}
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup(spark):
    got = by_id(line_dedup.dedup_lines(docs(spark)))
    assert {d: r.text for d, r in got.items()} == brute_lines(ODD)
    assert got[10].text == "eins\nzwei\ndrei\nvier" and got[10].removed_lines == 3 and got[11].text == "x\ny"
    assert {"_doc", "_text", "_id", "_starts", "_K0"} < set(got[1].asDict()) and line_dedup.dedup_lines(docs(spark).limit(0)).count() == 0
    assert got[11].spans == [[1, 4]] and got[1].n_lines == 0 and got[2].n_lines == 1


def test_line_dedup_random(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))), None, None, 0) for i in range(200)]
    rows += rows[:3]
    got = line_dedup.dedup_lines(docs(spark, rows)).collect()
    want = brute_lines(rows[:200])
    assert len(got) == 203 and all(r.text == want[r.doc_id] for r in got)


# --- SentencePiece


def test_encoding_equals_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    got = by_id(encode_texts(docs(spark), decoded=True))
    for doc, text, *_ in ODD:
        if text is None:
            assert got[doc].ids is None and got[doc].decodes is None and got[doc].n_tokens == 0
        else:
            assert got[doc].ids == library.encode(text) and got[doc].decodes
            assert got[doc].decoded == text.replace("▁", " ")
    assert encode_texts(docs(spark).limit(0)).count() == 0


def test_random_texts_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    coder = Transducer(Model(open(default_model(), "rb").read()), limit=50)
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("abcdefgh  ehilnorst▁\n\t éß日本語🎉<s>/0123") for _ in range(rng.randint(0, 60)))
        ids = np.frombuffer(coder.encode(text), np.int32).tolist()
        assert ids == library.encode(text)
        assert coder.decode(ids) == text.replace("▁", " ")


def brute_merge(text, scores):
    """Merge pair by pair: best score first, then leftmost."""
    symbols = list(text)
    while True:
        pairs = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not pairs:
            return symbols
        i = min(pairs)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_paths_are_what_merging_gives():
    model = Model(open(default_model(), "rb").read())
    coder = Transducer(model, limit=50)
    rng = random.Random(13)
    for alphabet in ("  \u2581", "the  ", "etaoinshrdlu ", "éß日本語🎉<s>/0123 ", "=-*/ #"):
        for _ in range(200):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
            want = b"".join(coder._packed(p) for p in brute_merge("\u2581" + text.replace(" ", "\u2581"), coder.scores))
            assert coder.encode(text) == want


@pytest.mark.parametrize("text", [" " * 300000, "a" * 300000, "  " + "etaoinshrdlu" * 25000])
def test_long_stretches_take_linear_time(text):
    coder = Transducer(Model(open(default_model(), "rb").read()))
    began = time.process_time()
    ids = np.frombuffer(coder.encode(text), np.int32).tolist()
    assert time.process_time() - began < 30
    assert coder.decode(ids) == text


def test_workers_keep_no_model_for_tasks_of_other_operators(spark):
    def models(batches):
        import gc

        import pyarrow as pa

        for batch in batches:
            held = sum(type(x).__name__ == "Transducer" for x in gc.get_objects())
            yield pa.RecordBatch.from_pydict({"models": [held] * batch.num_rows})

    texts = spark.range(64, numPartitions=8).select(F.concat(F.lit("some words "), "id").alias("text"))
    for _ in range(2):
        assert encode_texts(texts).where("decodes").count() == 64
        later = spark.range(16, numPartitions=16).mapInArrow(trimmed(models), "models bigint").collect()
        assert [r.models for r in later] == [0] * 16


@pytest.mark.parametrize(("prefix", "squeeze"), [(True, True), (True, False), (False, True), (False, False)])
def test_normaliser(prefix, squeeze):
    rng = random.Random(15)
    run = Normaliser(prefix, squeeze)
    for _ in range(500):
        text = "".join(rng.choice("a b ") for _ in range(rng.randint(0, 12)))
        want = re.sub(" +", " ", text.strip(" ")) if squeeze else text
        assert run(text) == (("\u2581" if prefix and want else "") + want.replace(" ", "\u2581"))


def test_unigram_paths_are_the_shortest():
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1), ("▁ab", -2.5, 1)]
    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([24, k])) for p, s, k in pieces)
    coder = Transducer(Model(body + field(2, bytes([24, 1])) + field(3, bytes([24, 1, 32, 0]))))
    assert np.frombuffer(coder.encode("ab"), np.int32).tolist() == [5]
    assert np.frombuffer(coder.encode("abb"), np.int32).tolist() == [5, 3]
    assert np.frombuffer(coder.encode("z"), np.int32).tolist() == [1, 0]


# --- chat


def test_chats_are_read_back(spark):
    texts = ["</s>[INST] ok [/INST]", "[\\INST]\\", "a [/TURN] <s> <\\\\/s>", "", None, "[OUT] x</s", "<", "[SYS] é日🎉\n[TURN 00] "]
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(60):
        turns = [(rng.choice(["system", "user", "assistant", "tool] ", "", None]), rng.choice(texts)) for _ in range(rng.randint(1, 6))]
        rows += [(conv, t, r, x) for t, (r, x) in enumerate(turns)]
        want[conv] = [(r or "", x or "") for r, x in turns]
    rng.shuffle(rows)
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1)))
    got = made.select("conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l")).collect()
    assert len(got) == 60
    for r in got:
        assert [tuple(t) for t in r.t] == want[r.conv_id]
        assert r.l == "".join(x for role, x in want[r.conv_id] if role == "assistant")


@pytest.mark.parametrize(("roles", "valid"), [("sua", True), ("uaua", True), ("uu", False), ("a", False), ("us", False), ("su", True), ("s", True)])
def test_turn_order(spark, roles, valid):
    name = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(None, i, name[r], "x") for i, r in enumerate(roles)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert [r.valid for r in made.collect()] == [valid]
    assert made.limit(0).count() == 0 and chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# --- mixing


def brute_fill(sizes, weights):
    total, targets, free = 1.5 * sum(sizes), {}, set(range(len(sizes)))
    while free:
        left = total - sum(targets.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if share[i] > 2 * sizes[i]}
        if not above:
            targets |= share
            break
        targets |= {i: 2.0 * sizes[i] for i in above}
        free -= above
    return [targets[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 100], [1, 1, 1, 1000], [0, 5, 0], [7], [0, 0], [3, 900, 20, 4, 50, 6, 1]])
def test_water_filling(spark, sizes):
    weights = [[5, 2, 1][i % 3] for i in range(len(sizes))]
    df = spark.createDataFrame([(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "stratum string, size bigint, weight bigint")
    got = [r.target for r in water_fill(df).orderBy("stratum").collect()]
    assert got == pytest.approx(brute_fill(sizes, weights))


def test_mixture_takes_what_it_should(spark):
    got = mix(docs(spark)).collect()
    assert len(got) == len(ODD) and {r.doc_id: r["size"] for r in got}[9] == 30000
    assert all(r.taken <= 2 * r["size"] for r in got)
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 50), None, rng.choice(["a", "a", "b", "c", None]), 0) for i in range(3000)]
    made = docs(spark, rows)
    got, again = mix(made).collect(), mix(made.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    for target in {r.target for r in got}:
        own = [r for r in got if r.target == target]
        assert abs(sum(r.taken for r in own) - target) <= 50
    assert mix(made.limit(0)).count() == 0


def test_a_long_document_does_not_end_the_refilled_mixture(spark):
    # 100 of the half of 1500 words are filled when a document of 500 is next
    order = sorted(range(201), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
    made = docs(spark, [(i, "w " * (500 if at == 100 else 5), None, "a", 0) for at, i in enumerate(order)])
    assert sum(r.taken for r in mix(made).collect()) == 2250 - 245
    assert sum(r.taken for r in mix(made, refill=True).collect()) == 2250
    assert mix(made.limit(0), refill=True).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_refilling_leaves_no_document_that_brings_a_source_nearer(spark, seed):
    rng = random.Random(seed)
    sizes = [(s, n) for s in "abc" for n in [600, 500, 400, *(rng.randint(1, 9) for _ in range(300))]]
    got = mix(docs(spark, [(i, "w " * n, None, s, 0) for i, (s, n) in enumerate(sizes)]), seed=str(seed), refill=True).collect()
    assert len(got) == len(sizes)
    for target in {r.target for r in got}:
        own = [r for r in got if r.target == target]
        miss, whole = target - sum(r.taken for r in own), min(r.repeats for r in own)
        assert all(abs(miss - r["size"]) >= abs(miss) for r in own if r.repeats == whole)


# --- WARC


def test_archives_are_read_back(spark):
    rng = random.Random(7)
    rows = [(i, f"http://x/{i}\n", rng.choice([None, "", "ab\r\n\r\ncd", "é" * 70000, f"own {i}"])) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archives = warc.write_archives(warc.with_revisits(pages), archive_bytes=2000)
    assert archives.count() > 10
    got = {r.page_id: r for r in warc.read_archives(archives, step=17).collect()}
    best = {}
    for page, _, html in rows:
        best[html or ""] = max(page, best.get(html or "", 0))
    assert len(got) == 200
    for page, _, html in rows:
        data, r = (html or "").encode(), got[page]
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = best[html or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if first == page else ("revisit", first))
        assert r.payload is None if first != page else bytes(r.payload) == data
    assert warc.read_archives(warc.write_archives(warc.with_revisits(pages.limit(0)))).count() == 0


def test_warc_files_are_written_and_read_as_streams(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i, f"u{i}", rng.choice([None, "", "é" * 3000, f"own {i} " + "x" * rng.randint(0, 500)])) for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    files = warc.write_warc_files(warc.with_revisits(pages), f"file://{tmp_path}/w", archive_bytes=1500)
    named = files.collect()
    assert sum(r.n_records for r in named) == 150 and len(named) > 6
    on_disk = {p.name: p.stat().st_size for p in (tmp_path / "w").iterdir()}
    assert on_disk == {r.archive.rpartition("/")[2]: r.n_bytes for r in named}
    got = {r.page_id: r for r in warc.read_warc_files(files, step=13).collect()}
    assert len(got) == 150
    for page, _, html in rows:
        data, r = (html or "").encode(), got[page]
        assert r.payload_bytes == len(data) and r.payload_digest == warc.base32_sha1(data)
        assert r.record_type == "revisit" or bytes(r.payload) == data
    assert warc.read_warc_files(warc.write_warc_files(warc.with_revisits(pages.limit(0)), f"file://{tmp_path}/none")).count() == 0
    first = tmp_path / "w" / sorted(on_disk)[0]
    first.write_bytes(first.read_bytes()[:-5])
    with pytest.raises(Exception, match="ends within a member"):
        warc.read_warc_files(files).count()


def test_columns_of_pages_are_kept(spark):
    pages = spark.createDataFrame([(1, "u", "ab", "mine", 5), (2, "u", "ab", "own", 6)], "page_id bigint, url string, html string, digest string, _k0 int")
    got = {r.page_id: (r.digest, r._k0, r.refers_to) for r in warc.with_revisits(pages).collect()}
    assert got == {1: ("mine", 5, 2), 2: ("own", 6, None)}


def test_small_payloads_do_not_revisit(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, None, "abc")], "page_id bigint, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.with_revisits(pages, min_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_broken_archives_are_refused(step):
    whole = warc.write_record("1", "u", b"payload" * 100) + warc.write_record("2", "u", b"x", refers_to="1")
    cut = lambda data: (data[i : i + step] for i in range(0, len(data), step))
    assert [r["payload_bytes"] for r in warc.read_records(cut(whole))] == [700, 1]
    for bad in (whole[:-3], whole[:50], whole[:80], b"no gzip"):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(cut(bad)))
    changed = zlib.decompress(whole, 31).replace(b"payloadpayload", b"payloadpayloae", 1)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records([packer.compress(changed) + packer.flush()]))


def foreign(kind, block, *more, content_type="application/http; msgtype=response"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", f"Content-Type: {content_type}", *more]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = "\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def test_archives_of_other_writers_are_read_from_files(spark, tmp_path):
    chunks = b"4\r\nwiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    inner = hashlib.sha256(b"wikipedia").hexdigest()
    made = [
        foreign("warcinfo", b"software: x\r\n", content_type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", content_type="application/http; msgtype=request"),
        foreign("response", head + chunks, f"WARC-Payload-Digest: sha-256:{inner}"),
        foreign("response", b"HTTP/1.1 200 OK\r\n\r\nbody"),
        foreign("response", b"a. 1 IN A 1.2.3.4", content_type="text/dns"),
        foreign("metadata", b"", content_type="application/warc-fields"),
        foreign("revisit", b"", f"WARC-Payload-Digest: sha1:{warc.base32_sha1(b'body')}"),
        warc.write_record("7", "u", b"own"),
    ]
    for step in (1, 7, 1 << 16):
        whole = b"".join(made)
        got = list(warc.read_records(whole[i : i + step] for i in range(0, len(whole), step)))
        assert [r["payload_bytes"] for r in got] == [13, 27, len(chunks), 4, 17, 0, None, 3]
    with pytest.raises(ValueError, match="payload digest"):
        list(warc.read_records([foreign("response", head + chunks, "WARC-Payload-Digest: sha-256:" + "0" * 64)]))
    archives = spark.createDataFrame([("a.warc.gz", bytearray(whole)), ("b.warc.gz", bytearray(made[3]))], "archive string, bytes binary")
    assert warc.write_files(archives, str(tmp_path)) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.warc.gz", "b.warc.gz"]
    back = warc.read_archives(warc.archive_files(spark, str(tmp_path))).collect()
    assert len(back) == 9 and [r.page_id for r in back if r.page_id] == [7]
    assert {r.payload_digest for r in back if r.payload == b"body"} == {warc.base32_sha1(b"body")}


@pytest.mark.parametrize("masks", [None, (0xF800, 0x7E0, 0x1F)])
def test_bitmaps_of_16_bits(masks):
    # three pixels a row, padded to four bytes, rows from the bottom up
    red, green, blue = masks or (0x7C00, 0x3E0, 0x1F)
    pixels = [[red, green, blue], [0, red | green | blue, 16 & blue]]
    body = b"".join(b"".join(v.to_bytes(2, "little") for v in row) + b"\0\0" for row in reversed(pixels))
    table = b"".join(m.to_bytes(4, "little") for m in masks or ())
    start = 54 + len(table)
    ints = lambda *v: b"".join(x.to_bytes(4, "little") for x in v)
    head = b"BM" + ints(start + len(body), 0, start, 40, 3, 2) + b"\1\0\x10\0" + ints(3 if masks else 0, len(body), 0, 0, 0, 0)
    want = [[[255, 0, 0], [0, 255, 0], [0, 0, 255]], [[0, 0, 0], [255, 255, 255], [0, 0, 132]]]
    assert media.decode(head + table + body).tolist() == want


# --- language ID

WORDS = {"en": ["the", "and", "with", "house", "water", "thing"], "de": ["und", "nicht", "schule", "wasser", "über", "ding"], "fr": ["le", "les", "avec", "maison", "château", "chose"]}


def test_languages_are_told_on_held_out_rows(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 80))), lang, "s", 0))
    extra = [(1000, None, "en", None, 0), (1001, "123 !? ½²", "en", None, 0), (1002, "", None, None, 0), (None, "the house and the water", None, None, 0)]
    got = by_id(langid.identify(docs(spark, rows + extra), min_margin=0.01))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and not got[1000].accepted
    assert got[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())


def test_samples_pass_over_null_texts_and_are_bounded(spark):
    rows = [(i, None if i % 2 else f"text {i}", "en", None, 0) for i in range(8)] + [(9, "abcdef" * 100, "de", None, 0)]
    got = langid.training_samples(docs(spark, rows), docs_per_lang=1, chars_per_doc=50)
    assert set(got) == {"en", "de"} and got["en"].startswith("text") and len(got["de"]) == 50 and got["de"] in "abcdef" * 100
    assert list(langid.training_samples(docs(spark, rows), max_langs=1)) == ["en"]


def test_the_smallest_encoding_wins(spark):
    """Predictions against plain compressors without the operator's tables."""
    import zstandard

    rng = random.Random(16)
    texts = {k: [" ".join(rng.choice(v) for _ in range(30)) for _ in range(40)] for k, v in WORDS.items()}
    primers = {k: "\n".join(v[:20]).encode() for k, v in texts.items()}
    model = langid.Compressors({k: langid.letters(v.decode()).encode() for k, v in primers.items()})
    for lang, own in texts.items():
        for text in own[20:]:
            sizes = {}
            for k, v in primers.items():
                words = zstandard.ZstdCompressionDict(langid.letters(v.decode()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                sizes[k] = len(zstandard.ZstdCompressor(level=19, dict_data=words).compress(langid.letters(text).encode()))
            assert model.best(text)[0] == min(sizes, key=sizes.get) == lang


def test_held_out_rows_of_the_tables(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    try:
        rows = spark.read.parquet(path)
    except Exception:
        pytest.skip("no test tables")
    made = langid.identify(rows).where(langid.held_out() & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    right, total = made.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert total > 200 and right >= 0.97 * total


def test_nothing_is_learned_without_labels(spark):
    got = langid.identify(docs(spark, [(1, "the house", None, None, 0)])).collect()
    assert [r.lang_pred for r in got] == ["und"]
    assert langid.identify(docs(spark).limit(0)).count() == 0


def test_held_out_matches_its_definition(spark):
    got = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


# --- exact dedup


def test_exact_dedup_edge_cases(spark):
    got = exact_dedup(docs(spark, ODD + [ODD[4]]), capacity=2)
    rows = got.collect()
    assert len(rows) == len(ODD) + 1
    groups = {}
    for doc, text, *_ in ODD + [ODD[4]]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, len(text or "")))
    for doc, text, *_ in ODD:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        own = groups[norm]
        keep = min(own, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        for r in (r for r in rows if r.doc_id == doc):
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), doc == keep)
            assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
    assert exact_dedup(docs(spark).limit(0)).count() == 0


def brute_directory(hashes, capacity, deepest):
    """Buckets (depth, prefix) by splitting one after the other."""
    out, todo = set(), [(0, 0)]
    while todo:
        depth, prefix = todo.pop()
        n = sum(h >> (64 - depth) == prefix for h in hashes)
        if n > capacity and depth < deepest:
            todo += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
        elif n:
            out.add((depth, prefix))
    return out


@pytest.mark.parametrize("spread", [1 << 64, 1 << 61, 40])
def test_directory_splits_and_doubles(spark, spread):
    rng = random.Random(9)
    hashes = {rng.randrange(spread) for _ in range(500)}
    signed = [(h - (1 << 64) if h >> 63 else h,) for h in hashes]
    slots, depth = directory(spark.createDataFrame(signed, "h bigint"), 20)
    got = slots.collect()
    deepest = 5 + SPARE_BITS if len(hashes) > 20 else 0
    if len(hashes) < 100:
        deepest = 1 + SPARE_BITS
    want = brute_directory(hashes, 20, deepest)
    assert depth == max(d for d, _ in want)
    assert {(r.slot, r.bucket, r.depth) for r in got} == {
        (s, p << (depth - d), d) for d, p in want for s in range(p << (depth - d), (p + 1) << (depth - d))
    }
    assert directory(spark.createDataFrame([], "h bigint"), 1)[1] == 0


@pytest.mark.parametrize("hash_of", [lambda c: F.lit(7), lambda c: F.length(c), lambda c: F.shiftleft(F.length(c).cast("bigint"), 60)])
def test_colliding_hashes_are_chained(spark, hash_of):
    rng = random.Random(14)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 6))), None, None, 0) for i in range(400)]
    got = by_id(exact_dedup(docs(spark, rows), capacity=2, hash_of=hash_of))
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(text.replace(" ", ""), []).append((-len(text), doc))
    for doc, text, *_ in rows:
        own, r = groups[text.replace(" ", "")], got[doc]
        assert (r.keep_id, r.group_size, r.kept) == (min(own)[1], len(own), min(own)[1] == doc)
    # one chain place a text, and equal places only in different buckets or hashes
    assert {(r.bucket, r.chain) for r in got.values() if len(groups) > 1} and max(r.chain for r in got.values()) > 1


def test_the_directory_routes_every_probe(spark, monkeypatch):
    """Without the right bucket no entry finds its group."""
    made = exact_dedup(docs(spark), capacity=1)
    assert made.select("bucket").distinct().count() > 3 and made.count() == len(ODD)
    assert exact_dedup_module.directory(docs(spark).select(F.xxhash64("text").alias("h")).distinct(), 1)[1] > 1


# --- n-gram join


def brute_classes(rows, k, num, den):
    sets = {}
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


@pytest.mark.parametrize(("k", "num", "paired"), [(4, 85, 64), (5, 80, 64), (2, 50, 64), (4, 85, 3), (2, 50, 5)])
def test_jaccard_classes_equal_brute_force(spark, k, num, paired, monkeypatch):
    own = ngram_join._group_pairs
    monkeypatch.setattr(ngram_join, "_group_pairs", lambda postings, apart: own(postings, apart, paired))
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 10)
    rng = random.Random(k)
    rows = []
    for i in range(300):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice("abcdefgh")
        else:
            words = [rng.choice("abcdefgh") + rng.choice("ABij") for _ in range(rng.randint(0, 60))]
        rows.append((i, "  ".join(words), None, None, 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs(spark, rows), k=k, num=num).collect()}
    assert got == brute_classes(rows, k, num, 100)


@pytest.mark.parametrize(("paired", "tokens"), [(64, 1 << 20), (3, 1 << 20), (3, 40)])
def test_every_link_is_counted(spark, paired, tokens, monkeypatch):
    own = ngram_join._group_pairs
    monkeypatch.setattr(ngram_join, "_group_pairs", lambda postings, apart: own(postings, apart, paired))
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 10)
    # blocks of few tokens: more blocks than sets, so that some are empty
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", tokens)
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("ij") for _ in range(40)) for _ in range(12)] + ["", None]
    # clusters of different near texts, and copies among them
    for _ in range(120):
        words = rng.choice(texts[:12]).split()
        words[rng.choice([0, 20, 39])] = rng.choice("klmno")
        texts.append(" ".join(words))
    texts += texts[20:40]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    rows += rows[30:33]
    sets = {}
    for doc, text, *_ in rows:
        words = (text or "").split()
        sets[doc] = {tuple(words[i : i + 2]) for i in range(len(words) - 1)}
    near = lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    want = {a: sum(near(sets[a], sets[b]) for b in sets if b != a) for a in sets}
    made = ngram_join.jaccard_classes(docs(spark, [*rows, (None, texts[0], None, None, 0)]), k=2, num=80).collect()
    assert {r.doc_id: r.n_links for r in made} == {**want, None: None}
    # far more than a forest holds
    assert sum(want.values()) > 4 * len(rows)


def test_common_tokens_come_last(spark, monkeypatch):
    """Every bitmap is full, so that all tokens are looked up: results stay, and no unrelated text is opened."""
    opened = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "WIDE", 4)
    monkeypatch.setattr(ngram_join, "_token_bitmap", lambda tokens: np.full(1 << (ngram_join.HOT_BITS - 6), (1 << 64) - 1, np.uint64))
    monkeypatch.setattr(ngram_join, "_verified", lambda df, *rest: (opened.append(df.count()), verified(df, *rest))[1])
    rng = random.Random(12)
    header = " ".join(f"head{i}" for i in range(31))
    rows = [(i, f"{header} " + " ".join(str(rng.random()) for _ in range(80)), None, None, 0) for i in range(600)]
    near = [(1000 + i, rows[i][1].rsplit(" ", 1)[0] + " end", None, None, 0) for i in range(40)]
    got = by_id(ngram_join.jaccard_classes(docs(spark, rows + near), k=4, num=85))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute_classes(rows[:40] + near, 4, 85, 100) | {
        i: (108, i) for i in range(40, 600)
    }
    assert opened[0] < 300


def rows_joined(df):
    """The most rows that a join of the plan makes, once it has run."""
    df.collect()

    def within(plan):
        own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() else 0
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        below += [getattr(plan, at)() for name, at in (("AdaptiveSparkPlan", "executedPlan"), ("QueryStage", "plan")) if name in plan.nodeName()]
        return max([own, *map(within, below)])

    return within(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("many", [150, 300])
def test_near_copies_are_ordered_without_joining_their_tokens(spark, many, monkeypatch):
    made, saved = [], ngram_join.saved
    monkeypatch.setattr(ngram_join, "saved", lambda df, name: (made.append(rows_joined(df)) if name == "late-prefixes" else None, saved(df, name))[1])
    rng = random.Random(15)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(many):
        own = list(words)
        own[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(own), None, None, 0))
    got = by_id(ngram_join.jaccard_classes(docs(spark, rows), k=4, num=85))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute_classes(rows, 4, 85, 100)
    # all are short of rare tokens; each comes once, not once for each of its 113 or more common tokens
    assert made == [many]


def test_rows_without_an_id_link(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:-1], x]) for x in ("a", "b", "c")]
    rows = [(7, near[0], None, None, 0), (None, near[1], None, None, 0), (None, "else " * 3, None, None, 0), (9, near[2], None, None, 0)]
    rows += [rows[0], (7, "other text", None, None, 0)]
    got = ngram_join.jaccard_classes(docs(spark, rows), k=4, num=85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_links if r.doc_id else -1, r.stays) for r in got) == [
        (0, 0, -1, True), (0, 7, -1, False), (7, 7, 0, True), (7, 7, 1, True), (7, 7, 1, True), (9, 7, 1, False)
    ]


def test_overlaps_are_counted_both_ways(monkeypatch):
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 80))) for _ in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) if i < j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    for rare in (1, 4, 100):
        monkeypatch.setattr(ngram_join, "RARE", rare)
        assert np.array_equal(ngram_join._overlaps(sets, columns=7), want)


def test_jaccard_classes_edge_cases(spark):
    got = by_id(ngram_join.jaccard_classes(docs(spark), k=4, num=85))
    want = brute_classes([r for r in ODD if r[0] is not None], 4, 85, 100)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items() if d is not None} == want
    assert len(got) == len(ODD)
    assert ngram_join.jaccard_classes(docs(spark).limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(10, 40)] + [(7, 7), (9, 8), (8, 9)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{j: 5 for j in (5, *range(10, 40))}, 8: 8, 9: 8}


# --- sharding


def test_shards_are_even_and_match_the_mixture(spark):
    rows = [(i, "é" * (i % 5), None, ["a", "b", "b", "b", None][i % 5], 0) for i in range(4003)]
    got = interleave(docs(spark, rows), shards=10).collect()
    assert len(got) == 4003
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert {len(x) for x in by.values()} == {400, 401}
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        share = sum(r.doc_id % 5 in (1, 2, 3) for r in own) / len(own)
        assert abs(share - 0.6) < 0.01
    assert all(r["size"] == 16 + 2 * (r.doc_id % 5) and r.text_crc32 == zlib.crc32(("é" * (r.doc_id % 5)).encode()) for r in got)


def test_no_cell_holds_most_rows(spark, monkeypatch):
    """Many sources of one row, and many rows of one id, are cut into small cells."""
    largest = []
    cut = running.celled

    def seen(*args):
        made = cut(*args)
        largest.append(made.groupBy("_cell").count().agg(F.max("count")).first()[0])
        return made

    for module in (running, sharding):
        monkeypatch.setattr(module, "celled", seen)
    ones = spark.range(20000).select("id", F.lit("x").alias("text"), F.col("id").cast("string").alias("source"))
    same = spark.range(20000).select(F.lit(None).cast("bigint").alias("id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    # at this size cells would be joined
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for rows in (ones, same):
        got = interleave(rows.withColumnRenamed("id", "doc_id")).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
        assert len(got) == 40 and all((r.n, r.m) == (500, 499) for r in got)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(largest) < 12000


def test_few_rows_leave_shards_empty(spark):
    got = interleave(docs(spark)).collect()
    assert sorted(r.shard for r in got) == [i * 40 // len(ODD) for i in range(len(ODD))]
    assert interleave(docs(spark).limit(0)).count() == 0
