"""Tokenizing, packing, url and vector operators against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attesta.llm import binary, bpe, packing, tokens, topk, urls

random.seed(5)
ODD = [None, "", "  ", "don't I'LL  we've\n\n x", "12½Ⅷ² é é", "日本語 テスト", "🙂🙂 ok", "İ Σας ΣΑΣ", "x\x1cy\x85z", "'s ''s\n's 'lll", "_a_b__--", "<|endoftext|> hi", "a" * 3000, "the cat sat on the mat. " * 400]
PIECES = ["don't", "'s", "''s", " 's", "\n's", "x're", "it'll", "  ", "\n\n ", "\t", "12", "½", "a", "é", "ß", "Σ", "日", "!?", "_", "'", "  y", "İ", "\U000558ab"]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(vocabulary, name):
    library, ours = Tokenizer.from_file(vocabulary(name)), tokens.TextEncoder(vocabulary(name), 1)
    texts = [t or "" for t in ODD] + ["".join(random.choice(PIECES) for _ in range(random.randint(0, 25))) for _ in range(800)]
    ids, offsets = ours(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids + [1], t


def test_encoder_forgets_without_harm(vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 5)
    ours = tokens.TextEncoder(vocabulary("byte_bpe_50k.json"), None)
    assert [ours([t])[0].tolist() for t in ("one two three four five six", "one two")] == [tokens.TextEncoder(vocabulary("byte_bpe_50k.json"), None)([t])[0].tolist() for t in ("one two three four five six", "one two")]


@pytest.fixture(scope="module")
def codec(vocabulary):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    import public_tokenizers

    return bpe.Codec(path), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def test_transducer_equals_library(codec, monkeypatch):
    ours, library = codec
    texts = [t or "" for t in ODD] + ["".join(random.choice(PIECES) for _ in range(random.randint(0, 25))) for _ in range(500)]
    for states in (100, 50_000):
        monkeypatch.setattr(bpe, "STATES", states)
        for t in texts:
            assert ours.encode(t) == library.encode_ordinary(t), t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(codec, text):
    ours, library = codec
    ids = ours.encode(text)
    assert ids == library.encode_ordinary(text)
    assert "".join(ours.decode_stream([i] for i in ids)) == text
    assert "".join(ours.decode_stream([ids])) == text


def test_stream_holds_back_unfinished_characters(codec):
    ours, _ = codec
    single = lambda data: np.array([ours.ranks[bytes([b])] for b in data], np.int64)
    s = ours.stream()
    assert [s.feed(single(b)) for b in (b"a\xf0\x9f", b"\x99", b"\x82b\xe6\x97")] == [b"a", b"", "🙂b".encode()] and s.close() == b"\xe6\x97"
    assert "".join(ours.decode_stream([[i] for i in single(b"\xff\x80\xe6\x97")])) == b"\xff\x80\xe6\x97".decode("utf-8", "replace")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=6), st.text(max_size=3).map(str.encode)), max_size=12), st.integers(1, 5))
def test_stream_equals_whole_decoding_of_any_bytes(codec, parts, size):
    ours, _ = codec
    data = b"".join(parts)
    ids = [i for p in parts for i in (ours.encode(p.decode("utf-8", "ignore")) if p.decode("utf-8", "ignore").encode() == p else [ours.ranks[bytes([b])] for b in p])]
    assert "".join(ours.decode_stream(ids[i : i + size] for i in range(0, len(ids), size))) == data.decode("utf-8", "replace")


def test_other_tokenizers_files_go_to_the_library(vocabulary, tmp_path):
    import json

    stored = json.load(open(vocabulary("byte_bpe_50k.json")))
    stored["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(stored))
    ids, offsets = tokens.TextEncoder(str(path), 1)(["one two", "", "three"])
    library = Tokenizer.from_file(str(path))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids + [1] for t in ("one two", "", "three")]
    assert tokens.known_pipeline(str(path)) is None and tokens.known_pipeline(vocabulary("word_bpe_49k.json")) is True


def test_bpe_query_columns(make, vocabulary, codec):
    _, library = codec
    found = by_id(bpe.encode_and_decode(make(ODD), vocabulary("byte_bpe_multi_50k.tiktoken"), with_ids=True))
    for i, t in enumerate(ODD):
        ids = library.encode_ordinary(t or "")
        assert (found[i]["n_tokens"], found[i]["ids"]) == (len(ids), ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_and_decode(make([]), vocabulary("byte_bpe_multi_50k.tiktoken")).count() == 0


def test_variable_length_code_round_trip():
    rng = np.random.default_rng(2)
    values = rng.choice([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], 1000).astype(np.uint32)
    cuts = np.sort(np.concatenate(([0, 1000, 10, 10], rng.integers(0, 1000, 40))))
    control, data = binary.pack(values, cuts)
    count = np.diff(cuts)
    assert [len(c) for c in control] == (-(-count // 4)).tolist()
    assert (binary.unpack(b"".join(control), b"".join(data), count) == values).all()


def test_token_files_hold_every_document_in_order(make, spark, vocabulary, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "BLOCK_BYTES", 200)
    ids = [40 - i for i in range(len(ODD))]
    path = str(tmp_path / "files")
    binary.write_token_files(make(ODD, ids=ids), path, vocabulary("word_bpe_49k.json"))
    found = by_id(binary.read_token_files(spark, path, with_ids=True))
    library, start = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    for i, t in sorted(zip(ids, ODD, strict=True)):
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert tuple(found[i])[1:4] == (start, len(want), crc(want)) and np.frombuffer(found[i]["ids"], "<u4").tolist() == want
        start += len(want)
    blocks = spark.read.parquet(path + "/blocks").orderBy("shard", "block").collect()
    assert [b["start"] for b in blocks] == sorted(b["start"] for b in blocks) and len(blocks) > 3


def test_token_files_of_odd_rows(make, spark, vocabulary, tmp_path):
    path = str(tmp_path / "odd")
    binary.write_token_files(make(["a", "a", "b c"], ids=[5, 5, None]), path, vocabulary("word_bpe_49k.json"))
    rows = sorted(binary.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 5, 5] and [r["start"] for r in rows] == [0, 3, 5]
    binary.write_token_files(make([]), path + "0", vocabulary("word_bpe_49k.json"))
    assert binary.read_token_files(spark, path + "0").count() == 0


def check_packing(pieces, texts, ids, library, window=2048):
    at, ends = {}, 0
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        want = library.encode(texts[ids.index(p["doc_id"])] or "", add_special_tokens=False).ids + [1]
        assert p["start"] == at.get(p["doc_id"], 0) and p["doc_tokens"] == len(want)
        assert p["ids_crc32"] == crc(want[p["start"] : p["start"] + p["length"]])
        at[p["doc_id"]] = p["start"] + p["length"]
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * window + p["offset"] == ends and p["offset"] + p["length"] <= window
        ends += p["length"]
    return ends


def test_packing_places_each_id_once(make, vocabulary):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = list(range(len(ODD)))
    docs = make(ODD, sources={0: None, 1: "b", 2: "b", 12: "c"})
    pieces = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json")).collect()
    total = check_packing(pieces, ODD, ids, library)
    assert total == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in ODD)
    assert packing.pack_documents(make([]), vocabulary("byte_bpe_50k.json")).count() == 0
    assert len(packing.pack_documents(make(["a", "a"], ids=[1, 1]), vocabulary("byte_bpe_50k.json")).collect()) == 2


def shares(rows, window=2048):
    """Share of each source in each whole window."""
    held = {}
    for r in rows:
        of = held.setdefault(r["sequence_id"], {})
        of[r["queue"]] = of.get(r["queue"], 0) + r["length"]
    return [{q: n / window for q, n in held[w].items()} for w in sorted(held) if sum(held[w].values()) == window]


def test_windows_keep_to_the_mixture(make, vocabulary):
    texts = ["word " * 400 for _ in range(60)]
    docs = make(texts, sources={i: "ab"[i % 3 == 0] for i in range(60)})
    for weights, share, n in ((None, 1 / 3, 10), ({"a": 1, "b": 1}, 1 / 2, 7)):
        rows = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), weights=weights, with_ids=True).collect()
        assert all(abs(w["b"] - share) < 0.002 for w in shares(rows)[:n])


def test_windows_of_twenty_sources_keep_to_the_mixture(make, vocabulary):
    rng = random.Random(3)
    texts = ["word " * rng.randint(1, 900) for _ in range(400)]
    docs = make(texts, sources={i: f"s{i % 20}" for i in range(400)})
    weights = {f"s{i}": 1 + i % 3 for i in range(20)}
    for given in (None, weights):
        rows = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), weights=given, with_ids=True).collect()
        total = {q: sum(r["length"] for r in rows if r["queue"] == q) for q in weights}
        want = {q: (given or total)[q] / sum((given or total).values()) for q in weights}
        whole = shares(rows)
        whole = whole[: len(whole) // 3 if given else -1]
        assert len(whole) > 20
        assert max(abs(w.get(q, 0) - want[q]) for w in whole for q in want) < 0.02


def test_many_sources_share_queues(make, vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    texts = [f"text {i} " * (i + 1) for i in range(20)]
    pieces = packing.pack_documents(make(texts, sources={i: f"s{i}" for i in range(20)}), vocabulary("byte_bpe_50k.json")).collect()
    check_packing(pieces, texts, list(range(20)), Tokenizer.from_file(vocabulary("byte_bpe_50k.json")))


def simulate(lengths, weights, window, packet):
    """Round-robin as it is told: deficits grow by the share of a window, whole quanta are sent while covered."""
    total, sent, tape, rounds = dict(lengths), dict.fromkeys(lengths, 0), [], 0
    one = 2**packing.UNIT
    unit = {q: max(1, round(w / sum(weights.values()) * one)) for q, w in weights.items()}
    quantum = {q: 1 if window * u >= packet * one else min(packet, total[q]) for q, u in unit.items()}
    deficit = {q: int(q * 0.6180339887498949 % 1 * quantum[q] * one) for q in lengths}
    while any(sent[q] < total[q] for q in total):
        rounds += 1
        for q in sorted(total):
            deficit[q] += window * unit[q]
            n = deficit[q] // (quantum[q] * one) * quantum[q]
            deficit[q] -= n * one
            n = min(n, total[q] - sent[q])
            if rounds * window * unit[q] >= total[q] * one:
                n = total[q] - sent[q]
            tape += [(q, sent[q] + i) for i in range(n)]
            sent[q] += n
    return tape


def test_many_sources_keep_their_weights(make, vocabulary):
    n = 1100  # more than MAX_QUEUES
    weights = {"big0": 0.5, "big1": 0.25} | {f"s{i}": 0.25 / n for i in range(n)}
    texts = ["a b c d e f g h " * 250] * 2 + ["one two three"] * n
    sources = {0: "big0", 1: "big1"} | {i + 2: f"s{i}" for i in range(n)}
    rows = packing.pack_documents(make(texts, sources=sources), vocabulary("byte_bpe_50k.json"), weights=weights, with_ids=True).collect()
    whole = shares(rows)
    assert abs(whole[0]["big0"] - 0.5) < 0.02 and abs(whole[0]["big1"] - 0.25) < 0.02
    by_source = {}
    for r in rows:
        by_source[r["queue"]] = by_source.get(r["queue"], 0) + r["length"]
    assert len(by_source) == n + 2


def test_closed_form_is_deficit_round_robin():
    lengths = {0: 1000, 1: 333, 2: 70, 3: 1}
    schedule = packing.Schedule(np.array(list(lengths.values())), np.array([5.0, 3, 1, 0.1]), 128, 16)
    tape = simulate(lengths, {0: 5, 1: 3, 2: 1, 3: 0.1}, 128, 16)
    for place, (q, i) in enumerate(tape):
        assert schedule.place(np.array([q]), np.array([i]))[0] == place
    doc, inside, length, at = schedule.pieces(np.array([0, 1, 1, 2, 3]), np.array([0, 0, 100, 0, 0]), np.array([1000, 100, 233, 70, 1]))
    for d, i, n, p in zip(doc, inside, length, at, strict=True):
        assert tape[p : p + n] == [([0, 1, 1, 2, 3][d], [0, 0, 100, 0, 0][d] + i + k) for k in range(n)]
    assert sum(length) == len(tape)


def test_url_rules_and_verdicts(spark):
    rows = [("https://a.example.com/en/71?x", "allow", "example.com/en/7"), ("http://EXAMPLE.com/en/1", "block", "com/en/"), ("http://notcom/en/1", None, None), ("http://x.net/de/8", "allow", "net/de/"), ("http://x.example.net/de/81", "block", "example.net/de/8"), ("no scheme", "allow", None), (None, "allow", None), ("http://", "allow", None), ("http://h#/en/", None, None)]
    good = [f"http://good{i}.net/de/{i}" for i in range(10, 60)]
    bad = [f"http://spam{i}.com/en/{i}" for i in range(10, 60)]
    more = [("http://good7.net/fr/10", "allow", None), ("http://spam7.com/xn/10", "block", None)]
    given = [u for u, _, _ in rows] + [u for u, _, _ in more] + good + bad
    pages = spark.createDataFrame([(i, u, "rule", 1.0) for i, u in enumerate(given)], "page_id bigint, url string, rule string, score double")
    found = by_id(urls.url_verdicts(pages), "page_id")
    for i, (_, verdict, rule) in enumerate(rows + more):
        assert found[i]["rule"] == rule and (verdict is None or found[i]["verdict"] == verdict), given[i]
    assert (found[1]["host"], found[1]["path"], found[8]["host"], found[8]["path"]) == ("example.com", "/en/1", "h", "")
    assert urls.url_verdicts(pages.limit(0)).count() == 0
    assert by_id(urls.url_verdicts(pages.filter("page_id = 2")), "page_id")[2]["verdict"] == "allow"


def test_url_model_is_fitted_on_every_url_that_a_rule_decides(spark):
    """More urls of either verdict than any sample held, in several shards, some twice, one long."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdeé"), 6))
    good = sorted({f"{word()}.net/de/{word()}" for _ in range(7500)})
    bad = sorted({f"{word()}.com/en/{word()}" for _ in range(7500)})
    open_ = [f"{word()}.{top}/{word()}" for top in ("net", "com", "org") for _ in range(20)] + ["long.org/" + "".join(rng.choice(list("abcdn/"), 500_000)) * 3]
    texts = open_ + good + bad + open_[:5] + good[:50]
    pages = spark.createDataFrame([(i, "http://" + t) for i, t in enumerate(texts)], "page_id bigint, url string").coalesce(1)
    found = by_id(urls.url_verdicts(pages), "page_id")
    ratio, cut = urls.fit(good, bad)
    assert len(found) == len(texts) and min(len(good), len(bad)) > 7000
    for i, t in enumerate(texts):
        if i < len(open_) or i % 50 == 0 or i >= len(texts) - 55:
            want = ratio.score(t)
            assert found[i]["score"] == pytest.approx(want, abs=1e-9), t[:50]
            assert found[i]["verdict"] == ("allow" if t in good else "block" if t in bad or want > cut else "allow")


def test_url_threshold_is_the_best_of_all_cuts(spark):
    rng = np.random.default_rng(7)
    for n, shift in ((400, 0.5), (400, 40), (2, 0), (1, -3)):
        good, bad = (np.round(rng.normal(m, 1, n), 2) for m in (0, shift))
        rows = [("allow", float(x)) for x in good] + [("block", float(x)) for x in bad]
        cut = urls.threshold(spark.createDataFrame(rows, "att_rule string, score double").repartition(3))
        wrong = lambda c: (good > c).mean() + (bad <= c).mean()  # noqa: B023, E731
        every = np.sort(np.concatenate((good, bad)))
        assert wrong(cut) == pytest.approx(min(map(wrong, [every[0] - 1, *every, 0.0])), abs=1e-12)
    for kinds in ([], ["allow"], ["block", "block"]):
        assert urls.threshold(spark.createDataFrame([(k, 1.0) for k in kinds], "att_rule string, score double")) == 0.0


def test_markov_smoothing_sums_to_one():
    model = urls.Markov(["abcab", "abd"], 3, alphabet=256)
    for context in ("", "a", "ab", "zz"):
        assert abs(sum(model.probability(context, chr(c)) for c in range(256)) - 1) < 1e-9


def brute_top(vectors, k=5):
    use = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in vectors.items() if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in (i for i in use if i % 50 == 0):
        scored = sorted((-int(use[q][: len(use[i])] @ use[i][: len(use[q])]), i) for i in use if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "PIECE", 16)
    rng = np.random.default_rng(3)
    vectors = {i: (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist() for i in range(400)}
    vectors |= {i: vectors[50] for i in range(400, 460)} | {460: None, 461: [1.0, None] + [0.0] * 6, 462: [float("nan")] * 8, 463: [float("inf")] * 8, 464: [1.0, 2.0], 500: [0.0] * 8, 550: [], 600: None}
    rows = spark.createDataFrame([(i, v, 1, 1) for i, v in vectors.items()] + [(None, [1.0] * 8, 1, 1)], "vec_id bigint, embedding array<double>, rank int, score int")
    found = {}
    for r in topk.top_inner_products(rows).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert found == brute_top(vectors)


def test_top_k_of_few_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.top_inner_products(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (50, [0.5, 0.5])], schema)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_inner_products(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 50), (50, 1, 1), (50, 2, 1), (50, 3, 0)]


def test_top_k_of_large_components_and_repeated_queries(spark):
    schema = "vec_id bigint, embedding array<double>"
    rows = spark.createDataFrame([(0, [5e9, 1.0]), (1, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [1e20, 0.0]), (50, [0.0, 0.0])], schema)
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_inner_products(rows.filter("vec_id < 4")).orderBy("rank").collect()]
    assert got == [(0, 1, 327680000000000), (0, 3, -327680000000000)]
    assert [r["score"] for r in topk.top_inner_products(rows.filter("vec_id in (4, 50)")).collect()] == [0]
    for beyond in ([(0, [5e9]), (2, [2e10])], [(0, [1.0]), (2, [1e308])]):
        with pytest.raises(Exception, match="OverflowError"):
            topk.top_inner_products(spark.createDataFrame(beyond, schema)).collect()
    twice = spark.createDataFrame([(50, [1.0]), (50, [2.0]), (7, [3.0])], schema)
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_inner_products(twice).collect()) == [(1, 7, 196608), (1, 7, 393216), (2, 50, 131072), (2, 50, 131072)]


def test_sets_of_like_reach():
    of, reach = topk._sets([(1, 3), (2, 5), (3, 20), (4, 1)], 8)
    assert of == {1: (0, 1), 2: (0, 1), 3: (1, 3), 4: (4, 1)} and reach == [2, 3, 3, 3, 4]
