"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from tessella.llm import arrowtext, linededup, minhash, mixing, packing, queries, repeats, telephony, toxicity, vectors, warc
from tessella.llm.components import components
from tessella.llm.staging import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(5)
VOCAB = ["the", "of", "Ähre", "a", "née", "x1", "it's", "end.", "IDIOT", "ß", "日本", "and,", "--", "zoom"]


def text(n):
    return " ".join(rng.choice(VOCAB, n))


SHARED = " ".join(f"w{k}" for k in range(70))


@cache
def documents():
    base = text(300)
    near = base.split()
    near[150] = "changed"
    lines = "Common Line\n" + text(10) + "\n  common line \n\n" + text(5)
    out = [None, "", " \n\t ", "one", "one two three", base, base, " ".join(near), text(5000), f"{text(30)} {SHARED} {text(20)}", f"{SHARED} {text(8)}", f"{text(9)} {SHARED}", lines]
    out += [f"{text(4)}\nCOMMON line\t\n{k}" for k in range(12)] + [text(60) for _ in range(5)] + ["ab" * 300, "ab" * 200, "z" * 500]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame([(i, t, None if i % 9 == 0 else f"s{i % 4}", i, -i) for i, t in documents()], "doc_id long, text string, source string, key long, size long")
    return made.repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_warc_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 80
    pages = [(1, "http://a/x", big), (2, "http://b/y\r\nX: 1", big), (3, None, None), (4, "http://c", "small"), (5, "http://c", "small"), (6, "http://d", big)]
    df = spark.createDataFrame(pages, "capture_id long, url string, payload string")
    path = new_path(spark, "warc")
    warc.write_warc(df, path)
    got = {r["response"]["record_id"]: r for r in warc.assemble(warc.read_warc(spark, path)).collect()}
    assert len(got) == 6 and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in got.values())
    assert bytes(got["<urn:capture:6:response>"]["response"]["payload"]) == big.encode()
    assert got["<urn:capture:1:revisit>"]["response"]["refers_to"] == "<urn:capture:6:response>"
    assert bytes(got["<urn:capture:3:response>"]["response"]["payload"]) == b""
    assert bytes(got["<urn:capture:5:response>"]["response"]["payload"]) == b"small"
    blank = new_path(spark, "warc")
    warc.write_warc(df.where("1 = 0"), blank)
    assert warc.assemble(warc.read_warc(spark, blank)).count() == 0


def test_assemble_follows_identifiers_both_ways_and_through_others(spark):
    r = lambda i, kind, to: (i, kind, to, None, None, None, 0, "", None)
    records = spark.createDataFrame([r("a", "response", ["q"]), r("q", "request", []), r("m", "metadata", ["q2"]), r("b", "response", []), r("q2", "request", ["b"]), r("lost", "metadata", ["none"])], warc.RECORD)
    got = {x["capture"]: ([q["record_id"] for q in x["requests"]], [m["record_id"] for m in x["metadata"]]) for x in warc.assemble(records).collect()}
    assert got == {"a": (["q"], []), "b": (["q2"], ["m"])}


def fill(sizes, weights, share, most):
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def test_mixing(spark, docs, empty):
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix(sizes, block_words=4).collect()
    again = mixing.mix(sizes.repartition(5), block_words=4).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in again} and len(got) == len(documents())
    true = {i: len(WORD.findall(t or "")) for i, t in documents()}
    per = defaultdict(int)
    for i, n in true.items():
        per[None if i % 9 == 0 else f"s{i % 4}"] += n
    names = [*sorted(k for k in per if k), None]
    want = fill(per, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == true[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 8
    assert mixing.mix(empty.select("doc_id", "source", F.lit(0).cast("long").alias("size"))).count() == 0


def test_mixed_texts_are_the_chosen_blocks(spark):
    """Every word of a stage's text is one that the mix's blocks hold, in place, so tails are taken as often as heads."""
    import corpus_pipeline as pipeline

    texts = {i: " ".join(f"d{i}w{k}" for k in range(40 + 7 * i)) for i in range(30)}
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in texts.items()], "doc_id long, text string, source string")
    sizes = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan, got = mixing.mix(sizes).collect(), {r["doc_id"]: r["text"] for r in pipeline.mix_sources(spark, df, "").collect()}
    want = {}
    for r in plan:
        words = texts[r["doc_id"]].split()
        some = [w for s in r["spans"] for w in words[s["begin"] : s["end"]]]
        assert r["taken"] == r["rounds"] * r["size"] + len(some) and len(set(some)) == len(some)
        if r["taken"]:
            want[r["doc_id"]] = words * r["rounds"] + some
    assert {i: t.split() for i, t in got.items()} == want
    assert any(0 < s["begin"] for r in plan for s in r["spans"][:1]) and any(r["spans"] and r["spans"][-1]["end"] == r["size"] for r in plan)


def test_blocks_are_picked_by_a_permutation(spark):
    for n in (1, 2, 7, 1000, 8192):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit("s"), F.lit(3)]).alias("p"), mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit("s"), F.lit(4)]).alias("q")).toPandas()
        assert sorted(rows["p"]) == list(range(n)) and (n < 7 or (rows["p"] != rows["q"]).any())
        if n >= 1000:  # neither runs nor strides: as many of the first half fall into the first half as chance lets
            assert abs((rows["p"][: n // 2] < n // 2).mean() - 0.5) < 0.06 and len(set(np.diff(rows["p"]))) > n // 4


def test_sainte_lague_equals_highest_quotients(spark):
    for votes, seats in (([53.0, 24.0, 23.0, 0.0], 7), ([10.0, 10.0, 10.0], 5), ([1.0, 1000.0], 3), ([5.0, 3.0, 1.0], 0), ([1e6, 3.0, 2.0], 500)):
        df = spark.createDataFrame([(1, k, v, seats) for k, v in enumerate(votes)], "g int, k int, votes double, seats long")
        got = {r["k"]: r["out"] for r in mixing.sainte_lague(df, ["g"], ["k"], "votes", "seats", "out").collect()}
        want = [0] * len(votes)
        for _ in range(seats):
            want[max(range(len(votes)), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))] += 1
        assert [got[k] for k in range(len(votes))] == want


def removed(texts, tokens, width):
    first, gone = {}, {}
    for i in sorted(texts):
        t = tokens(texts[i])
        gone[i] = [False] * len(t)
        for a in range(len(t) - width + 1):
            if first.setdefault(tuple(t[a : a + width]), i) < i:
                gone[i][a : a + width] = [True] * width
    return gone


@pytest.mark.parametrize("kind", ["words", "bytes"])
@pytest.mark.parametrize("width", [50, 17])
def test_repeats(docs, kind, width):
    texts = {i: t or "" for i, t in documents()}
    tokens = (lambda t: WORD.findall(t)) if kind == "words" else (lambda t: list(t.encode()))
    gone = removed(texts, tokens, width)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs, kind, width).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        kept = [x for x, g in zip(tokens(t), gone[i], strict=True) if not g]
        raw = " ".join(kept).encode() if kind == "words" else bytes(kept)
        assert got[i]["n_removed"] == sum(gone[i]) and bytes(got[i]["kept"]) == raw and got[i]["kept_sha256"] == hashlib.sha256(raw).hexdigest()
        spans = got[i]["spans"]
        assert sum(b - a for a, b in zip(spans[::2], spans[1::2], strict=True)) == sum(gone[i]) and got[i]["n_spans"] * 2 == len(spans)


def test_repeats_of_nothing(empty):
    assert repeats.remove_repeats(empty, "words").count() == 0


def test_line_dedup(docs, empty):
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs.withColumn("n_lines", F.lit("clash"))).collect()}
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    count = defaultdict(set)
    for i, t in documents():
        for x in (t or "").split("\n"):
            count[key(x)].add(i)
    for i, t in documents():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(count[key(x)]) < 10]
        assert got[i]["n_lines"] == len(lines) and got[i]["n_dropped"] == len(lines) - len(kept)
        assert got[i]["text"] == ("\n".join(kept) if t is not None else None) and got[i]["key"] == i
    assert sum(r["n_dropped"] for r in got.values()) == 14 and linededup.dedup_lines(empty).count() == 0


def test_line_runs_compact_and_tell_new_lines(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for b in range(4):
        runs.add(spark.createDataFrame([(k, -k) for k in range(b, b + 3)], "k1 long, k2 long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    first = {r["k1"]: r["docs"] for r in runs.first().collect()}
    assert first == dict.fromkeys(range(6), 1)  # each key once, in the run of the batch that brought it
    assert sum(m.count() for m in runs.more) == 6
    assert {r["k1"] for r in runs.common(2).collect()} == {1, 2, 3, 4} and {r["k1"] for r in runs.common(3).collect()} == {2, 3}
    assert [r["k1"] for r in runs.unseen(spark.createDataFrame([(5, -5), (9, -9), (5, 5)], "k1 long, k2 long")).orderBy("k1", "k2").collect()] == [5, 9]


def test_long_words_of_two_letters_do_not_collide():
    """The Thue-Morse word and its complement, which polynomial hashes modulo a power of two can't tell apart."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (64, 1024, 2048, 4096):
        raw = np.frombuffer((word[:n] + other[:n]).encode(), np.uint8)
        a, b = arrowtext.span_hashes(raw, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
        data, offs = raw, np.array([0, n, 2 * n])
        assert len(np.unique(linededup.line_keys(data, offs)[3])) == 2 and len(np.unique(minhash.shingle_sets(data, offs, 4)[0])) == 2


def test_near_duplicates(docs, empty):
    sets = {}
    for i, t in documents():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, words=4).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert sum(not r["kept"] for r in got.values()) >= 2 and minhash.near_duplicates(empty).count() == 0


def test_small_regions_are_paired_completely(spark):
    """Nine documents with ids in a row share one region."""
    sig = bytes(range(4 * minhash.DEPTH))
    reps = spark.createDataFrame([(i, [sig]) for i in range(9)], "doc_id long, sigs array<binary>")
    pairs, crowded = minhash.candidates(reps)
    assert {(r["lo"], r["hi"]) for r in pairs.collect()} == {(a, b) for a in range(9) for b in range(a + 1, 9)} and crowded.count() == 0


@pytest.mark.parametrize("batch,kinds", [(40, 3), (10_000, 3), (7, 6), (64, 12)])
def test_neighbours_miss_no_shared_region(spark, batch, kinds):
    """Regions of all sizes over many ranges and batches: documents that share one are a pair or both lie in crowded regions."""
    r = np.random.default_rng(kinds)
    sigs = r.integers(0, kinds, (500, 2, minhash.DEPTH)).astype(">u4")
    reps = spark.createDataFrame([(i, [t.tobytes() for t in s]) for i, s in enumerate(sigs)], "doc_id long, sigs array<binary>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        pairs, crowded = minhash.candidates(reps)
        pairs, crowded = {(r["lo"], r["hi"]) for r in pairs.collect()}, {r["doc_id"] for r in crowded.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    shared = {(a, b) for t in range(2) for a in range(500) for b in range(a + 1, 500) if (sigs[a, t, :2] == sigs[b, t, :2]).all()}
    assert pairs <= shared and all((a, b) in pairs or {a, b} <= crowded for a, b in shared)
    sizes = [Counter(map(bytes, sigs[:, t, :2])) for t in range(2)]
    assert crowded == {i for i in range(500) if any(sizes[t][bytes(sigs[i, t, :2])] > minhash.SMALL_REGION for t in range(2))}


def test_near_duplicates_on_one_template(spark):
    """400 documents of one long template, similarity 0.71, with 100 pairs at 0.80 among them: all regions are crowded."""
    body, texts = [f"t{k}" for k in range(300)], []
    for i in range(400):
        tail = [f"d{i}w{k}" for k in range(60)]
        if i < 200 and i % 2:
            tail[:24] = [f"d{i - 1}w{k}" for k in range(24)]
        texts.append(" ".join(body + tail))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want == {(a, a + 1) for a in range(0, 200, 2)}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, words=4, trees=8).collect()}
    assert got == {i: i - i % 2 if i < 200 else i for i in range(400)}


def test_components(spark):
    links = [(k, k + 1) for k in range(10, 40)] + [(100, 200), (200, 100), (7, 7), (300, 200)] + [(50, k) for k in range(500, 560)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 10 for k in range(10, 41)}, 100: 100, 200: 100, 300: 100, 50: 50, **{k: 50 for k in range(500, 560)}}


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.word_tokenizer())
    for length in (16, 4096):
        got = packing.pack(docs, packing.word_tokenizer(), length).collect()
        at = defaultdict(dict)
        for r in got:
            at[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
            assert r["length"] == len(at[r["doc_id"]][r["start"]])
        for i, t in documents():
            assert sum((at[i][s] for s in sorted(at[i])), []) == [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        full = defaultdict(list)
        for r in got:
            full[r["sequence_id"]].append((r["offset"], r["length"], r["padded"]))
        last = max(full)
        for s, ps in full.items():
            ps.sort()
            assert [p[0] for p in ps] == list(np.cumsum([0] + [p[1] for p in ps])[:-1])
            n = sum(p[1] for p in ps)
            assert n == length if s < last else n <= ps[0][2] <= length and (ps[0][2] & (ps[0][2] - 1) == 0)
    assert packing.pack(empty, packing.word_tokenizer()).count() == 0


def test_packing_query(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.word_tokenizer())
    rows_ = packing.op5_packing(spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: np.array([*tk.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    held = defaultdict(int)
    for r in rows_:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        held[r["doc_id"]] += r["length"]
    assert held == {i: len(x) for i, x in want.items()}


def test_pieces_are_told_apart_by_their_bytes():
    """Texts that collide under polynomial hashes get their own ids, also when the memory of pieces is full."""
    from tokenizers import Tokenizer

    tk, ids = Tokenizer.from_file(packing.word_tokenizer()), packing.PieceIds(packing.word_tokenizer(), most=4)
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "it's a1 \u00e9 x. y! z", "x y \u304b z", ""]
    for _ in range(2):
        raw = [t.encode() for t in texts]
        got, sizes = ids.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        want = [[*tk.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
        assert got.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_mixing_query(spark):
    got = mixing.op2_mixing(spark, DATA).collect()
    docs_ = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sizes = {i: len(WORD.findall(r["text"] or "")) for i, r in docs_.items()}
    per, taken = Counter(), Counter()
    for i, n in sizes.items():
        per[docs_[i]["source"]] += n
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == per[docs_[r["doc_id"]]["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[docs_[r["doc_id"]]["source"]] += r["taken"]
    names = [*sorted(k for k in per if k is not None), *[None] * (None in per)]
    want = fill(per, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5, 2.0)
    assert len(got) == len(docs_) and all(abs(taken[s] - want[s]) <= 32 for s in per)
    assert all(r["target"] == pytest.approx(want[docs_[r["doc_id"]]["source"]]) for r in got)


def test_packing_keeps_added_tokens():
    from tokenizers import Tokenizer

    tk, ids = Tokenizer.from_file(packing.word_tokenizer()), packing.PieceIds(packing.word_tokenizer())
    texts = ["a<|endoftext|>b", "<|startoftext|> x (<|endoftext|>)<|endoftext|>", "<|ENDOFTEXT|> \u00e9<|endoftext|>'s 12<|endoftext|>3", "<|endof", "text|>", "<<|endoftext|>>"]
    raw = [t.encode() for t in texts]
    got, sizes = ids.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [[*tk.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
    assert got.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_telephony(spark, docs, empty):
    media = telephony.encode(docs)
    got = {r["doc_id"]: r for r in telephony.decode(media).collect()}
    for i, t in documents():
        raw = (t or "").encode()
        full = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        pcm = np.frombuffer(r["pcm"], np.int16)
        assert f"samples={len(pcm)};" in r["feature"] and r["sample_rate"] == 16000
    assert got[5]["media_sha256"] == got[6]["media_sha256"] and got[5]["feature"] == got[6]["feature"]
    assert telephony.decode(telephony.encode(empty)).count() == 0
    assert telephony.decode(media.withColumn("media", F.lit(None).cast("binary"))).first()["feature"] is None


def test_stored_pcm_is_the_resampled_signal(spark, docs):
    """Stored PCM read back: samples of the codes at even places, the half-band filter between them, features of the stored samples."""
    media, path = telephony.encode(docs), new_path(spark, "pcm")
    telephony.store_pcm(media, path)
    files = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    for r in spark.read.parquet(path).collect():
        tag, size, body = telephony.open_wav(files[r["doc_id"]])
        narrow = telephony.decode_adpcm(body.reshape(-1, size)).reshape(-1) if tag == telephony.ADPCM else telephony.TABLES[tag][body]
        pcm = np.frombuffer(r["pcm"], np.int16)
        assert r["sample_rate"] == 16000 and (pcm[::2] == narrow).all()
        x = np.pad(narrow.astype(int), (1, 2), "edge")
        assert (pcm[1::2] == np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) // 16, -32768, 32767)).all()
        wide = pcm.astype(int)
        crossings = int((np.diff(np.signbit(pcm).astype(int)) != 0).sum())
        assert r["feature"] == f"codec={telephony.NAMES[tag]};samples={len(pcm)};mean_square={int((wide * wide).sum()) // len(pcm)};peak={abs(wide).max()};crossings={crossings}"


def test_telephony_query(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = telephony.op6_telephony(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r["doc_id"]]
        full = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = telephony.wav(telephony.CODECS[zlib.crc32(full) % 3], full)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs_, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs_, labels), toxicity.train(docs_.withColumn("lang", F.lit("x")), flipped)
    assert (a.keys == b.keys).all() and (a.weights == b.weights).all() and (a.decay, a.log_k, a.logit) == (b.decay, b.log_k, b.logit)
    got = {r["doc_id"]: r["held_out"] for r in toxicity.op4_toxicity(spark, DATA).collect()}
    assert got == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs_.collect()}


def test_adpcm_blocks_against_one_by_one():
    blocks = rng.integers(0, 256, (7, 36), dtype=np.uint8)
    blocks[:, 2] %= 89
    for block, got in zip(blocks, telephony.decode_adpcm(blocks), strict=True):
        value, index, want = int(block[:2].view("<i2")[0]), int(block[2]), [int(block[:2].view("<i2")[0])]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code])))
                want.append(value)
        assert got.tolist() == want


def test_companding_tables():
    mu, a = telephony.TABLES[telephony.MULAW], telephony.TABLES[telephony.ALAW]
    assert mu[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0] and a[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def test_segments_are_maximal():
    def brute(x):
        """Maximal scoring subsequences by their definition: the best one, then the same left and right of it."""
        best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-9:
            return []
        i, j = best[2], best[3]
        return [*brute(x[:i]), (round(best[0], 6), i, j - 1), *[(s, a + j, b + j) for s, a, b in brute(x[j:])]]

    for _ in range(30):
        x = np.full(40, -toxicity.COST)
        x[rng.choice(40, 8, replace=False)] = (rng.random(8) * 1.7 - 1).round(3)
        at, high = np.flatnonzero(x > 0), np.cumsum(x)
        got = toxicity.segments(at.tolist(), (high - x)[at].tolist(), high[at].tolist())
        assert sorted(round(s, 6) for s, _, _ in got) == sorted(s for s, _, _ in brute(x.tolist()))


def test_tokens_of_any_script_and_length():
    raw = "I'm (an) IDIOT, you-idiot \u611a\u304b\u8005\u3060x \u00e9a! \U0001f600".encode()
    w = toxicity.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[a:b].decode() for a, b in zip(w.starts, w.ends, strict=True)] == ["I", "m", "an", "IDIOT", "you", "idiot", *"\u611a\u304b\u8005\u3060", "x", "\u00e9a", "\U0001f600"]
    assert w.hash[3] == w.hash[5]


def test_toxicity(spark, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = docs.select("doc_id", "text", F.lit("x").alias("score")).unionByName(spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "scum idiot moron trash " * 3, "x")], "doc_id long, text string, score string"))
    model = toxicity.train(docs, labels)
    got = toxicity.score(odd, model).toPandas().set_index("doc_id")
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    assert got.loc[-1, "predicted"] == 0 and got.loc[-2, "predicted"] == 0 and got.loc[-3, "predicted"] == 1
    known = labels.toPandas().set_index("doc_id")["toxic"]
    held = [i for i in known.index if zlib.crc32(str(i).encode()) % 5 == 0]
    assert (got.loc[held, "predicted"] == known[held]).mean() >= 0.95
    assert toxicity.score(empty, model).count() == 0
    assert not toxicity.train(docs, labels.where("toxic = 0")).weights.any()


def test_top_k(spark, monkeypatch):
    vecs = [(i, rng.normal(size=20).tolist()) for i in range(0, 130)] + [(200, None), (250, [1.0, None]), (300, [float("nan")] * 20), (350, [float("inf")] + [0.0] * 19), (400, [0.5, -0.25]), (450, [])]
    vecs += [(500 + i, vecs[i][1]) for i in range(5)]
    df = spark.createDataFrame(vecs, "vec_id long, e array<float>").select("vec_id", vectors.quantised(F.col("e")).alias("v"))
    monkeypatch.setattr(vectors, "QUERIES", 3)
    monkeypatch.setattr(vectors, "CANDIDATES", 16)
    got = [tuple(r) for r in vectors.top_k(df.where("vec_id % 50 = 0"), df, 5).orderBy("query_id", "rank").collect()]
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vecs if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    wide = {i: np.pad(v, (0, 20 - len(v))) for i, v in ok.items()}
    want = [(q, r + 1, i, s) for q in sorted(ok) if q % 50 == 0 for r, (s, i) in enumerate(sorted(((int(wide[q] @ wide[c]), c) for c in ok if c != q), key=lambda x: (-x[0], x[1]))[:5])]
    assert got == want
    assert vectors.top_k(df.where("1 = 0"), df.where("1 = 0"), 5).count() == 0


def test_word_spans_on_odd_text():
    import pyarrow as pa

    texts = [t for _, t in documents()]
    data, offs = arrowtext.string_buffer(pa.array(texts))
    starts, ends, doc = arrowtext.word_spans(data, offs)
    raw = data.tobytes()
    assert [(d, raw[a:b].decode()) for a, b, d in zip(starts, ends, doc, strict=True)] == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for name, step in pipeline.STAGES:
        out = step(spark, docs, DATA)
        path = new_path(spark, name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "packing":
            assert after.columns == docs.columns
            docs = after
        sizes.append(after.select("doc_id").distinct().count())
    assert [s[0] for s in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] >= sizes[4] == sizes[5] > 0


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in all columns, empty and repeated rows, one very long text, and columns named like the operators' own."""
    import corpus_pipeline as pipeline

    own = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, n_lines long, n_dropped string, passages string, spans string, rounds int, `__id` int, `a.b` string"
    plain = lambda i, t, s="s": (i, t, None, s, None, "keep", 1, -1, "keep", None, "keep", 7, 3, "keep")
    long = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    rows_ = [plain(0, None), plain(2, ""), plain(4, long), plain(6, "same words here and there today"), plain(8, "same words here and there today", None), plain(None, "a row without an id"), plain(10, None, None)]
    rows_ += [plain(12, "this row stands in the table twice")] * 2 + [plain(100 + k, f"one own line {k}\nshared by many") for k in range(12)]
    docs_ = spark.createDataFrame(rows_, own)
    key = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1 for r in df.collect()))
    every = key(docs_)
    done = {}
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, docs_, DATA)
        assert out.columns == docs_.columns and all(r["score"] == "keep" and r["predicted"] == 1 and r["n_lines"] == -1 and r["a.b"] == "keep" and r["rounds"] == 7 for r in out.collect()), name
        done[name] = out
        assert step(spark, docs_.where("1 = 0"), DATA).count() == 0
    assert key(done["toxicity"]) == every and key(done["line_dedup"]) == every
    texts = {r["doc_id"]: r["text"] for r in done["line_dedup"].collect()}
    assert texts[0] is None and texts[2] == "" and texts[4] == long and texts[105] == "one own line 5"
    assert key(done["near_dedup"]) == [i for i in every if i != 8]
    mixed = {r["doc_id"]: r for r in done["mixing"].collect()}
    assert not {0, 2, 10, None} & set(mixed) and all(r["text"] and r["n_chars"] == len(r["text"]) for r in mixed.values())
    assert pipeline.pack(spark, docs_, DATA).select("doc_id").distinct().count() == len(set(every)) and pipeline.pack(spark, docs_.where("1 = 0"), DATA).count() == 0
