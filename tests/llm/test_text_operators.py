"""Operators on words and bytes against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import language, minhash, perplexity, quality, repeats
from attesta.llm.common import raw, slices, words

random.seed(4)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(300)]
sentence = lambda n, r=random: " ".join(r.choice(WORDS) for _ in range(n))
EDGES = [None, "", "   \n", "one", "one two three", "é ß 日本 🙂", "x " * 30_000]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_words_and_slices():
    data, offsets = raw(pa.array(["a b", None, "", "\tcd\x0be", "é"]))
    start, stop, row = words(data, offsets)
    assert [(bytes(data[a:b]).decode(), r) for a, b, r in zip(start, stop, row, strict=True)] == [("a", 0), ("b", 0), ("cd", 3), ("e", 3), ("é", 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 7)], ["t"])
    assert [s.num_rows for s in slices(batch, "t", 25)] == [2, 2, 2, 1]


def shingle_counts(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def test_near_duplicates_equal_brute_force(make):
    texts = []
    for _ in range(25):
        base = sentence(80).split()
        texts.append(" ".join(base))
        for k in (1, 2, 5):
            other = list(base)
            for _ in range(k):
                other[random.randrange(80)] = random.choice(WORDS)
            texts.append(" ".join(other))
    texts += texts[:5] + EDGES
    counts, parent = [shingle_counts(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            shared = sum((counts[a] & counts[b]).values())
            if counts[a] and shared >= 0.8 * (sum(counts[a].values()) + sum(counts[b].values()) - shared):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    found = by_id(minhash.near_duplicates(make(texts)))
    assert [found[i]["class_id"] for i in range(len(texts))] == [root(i) for i in range(len(texts))]
    sizes = Counter(root(i) for i in range(len(texts)))
    assert all(found[i]["class_size"] == sizes[root(i)] for i in found)


def test_near_duplicates_of_odd_rows(make):
    text = sentence(40)
    got = minhash.near_duplicates(make([text, text, text, None], ids=[7, 7, None, 3])).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"]) for r in got) == [(-1, 7), (3, 3), (7, 7), (7, 7)]
    assert minhash.near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("n", range(7))
def test_near_duplicates_of_a_few_words(make, n):
    texts = [" ".join("abcdefg"[:n]), " ".join("tuvwxyz"[:n])]
    for use in (texts[:1], texts, texts + texts[:1]):
        found = by_id(minhash.near_duplicates(make(use)))
        assert found[0]["class_id"] == 0 and found[len(use) - 1]["class_id"] == (0 if len(use) == 3 and n else len(use) - 1)
    for size in range(n + 3):
        hashes, row = minhash.shingles(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0])]), size + 1)
        assert len(hashes) == len(row) == (max(1, n - size) if n else 0)


def test_shared_cells_are_counted_exactly():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, 80)).astype(np.uint64) for _ in range(20)]
    got = minhash.shared_cells(np.concatenate(sets), np.repeat(np.arange(20), [len(x) for x in sets]), 20, 64)
    assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(20) for b in range(20) if a != b)


@pytest.mark.parametrize("wide", [0, 1, 100])
def test_buckets_of_many_classes_lose_no_link(make, monkeypatch, wide):
    """Copies of one text at many distances: most miss 0.8 against any pivot, and some still reach each other."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "WIDE", wide)
    rng = random.Random(8)
    base, texts = sentence(120, rng).split(), []
    for _ in range(60):
        other = list(base)
        for _ in range(rng.randint(1, 6)):
            other[rng.randrange(120)] = "".join(rng.choice("xyz") for _ in range(9))
        texts.append(" ".join(other))
    counts, label = [shingle_counts(t) for t in texts], list(range(60))
    for a in range(60):
        for b in range(a):
            shared = sum((counts[a] & counts[b]).values())
            if shared >= 0.8 * (sum(counts[a].values()) + sum(counts[b].values()) - shared) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    assert 1 < len(set(label)) < 60
    found = by_id(minhash.near_duplicates(make(texts)))
    assert [found[i]["class_id"] for i in range(60)] == label


def test_one_large_group_of_near_copies(make):
    base = sentence(120).split()
    texts = []
    for _ in range(300):
        other = list(base)
        other[random.randrange(120)] = random.choice(WORDS) + "x"
        texts.append(" ".join(other))
    assert {r["class_id"] for r in minhash.near_duplicates(make(texts)).collect()} == {0}


def test_dart_agreement_is_weighted_jaccard():
    k, n = 512, 400
    a = np.arange(n, dtype=np.uint64)
    cells = minhash.mix(np.concatenate((a, a + np.uint64(100))) + np.uint64(12345))
    row = np.repeat([0, 1], n)
    signature, whole = minhash.dart_signatures(cells, row, 3, k)
    assert whole.tolist() == [True, True, False]
    assert abs((signature[0] == signature[1]).mean() - 300 / 500) < 0.08
    half, _ = minhash.dart_signatures(np.concatenate((cells[:n], cells[:n])), row, 2, k, np.concatenate((np.ones(n), np.full(n, 0.5))))
    assert abs((half[0] == half[1]).mean() - 0.5) < 0.08


def brute_repeats(texts, depth):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + depth] for b in data for i in range(len(b) - depth + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("blocks", "limit", "chunk"), [((32, 6, 1), 4096, 1 << 14), ((32, 6, 1), 3, 5), ((1,), 0, 5)])
def test_repeats_equal_brute_force(make, monkeypatch, blocks, limit, chunk):
    for name, value in (("BLOCKS", blocks), ("LIMIT", limit), ("CHUNK", chunk)):
        monkeypatch.setattr(repeats, name, value)
    shared = sentence(30)
    texts = [sentence(60) for _ in range(6)]
    texts += [t[:100] + shared + t[100:] for t in texts] + [shared[3:] + "é日" * 70, "é日" * 70, "ab" * 400, texts[0], "z" * 199, "y" * 200, "w" * 201, None, ""]
    for _ in range(12):
        t = list(random.choice(texts[:12]))
        t[random.randrange(len(t))] = "#"
        texts.append("".join(t))
    found = by_id(repeats.repeat_report(make(texts)))
    assert [tuple(found[i])[1:] for i in range(len(texts))] == brute_repeats(texts, 200)


def test_repeats_in_long_text_and_odd_rows(make, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 3000)
    long = sentence(4000)
    texts = [long, long[5000:9000], "tail " + long[-900:]]
    found = by_id(repeats.repeat_report(make(texts)))
    assert [tuple(found[i])[1:] for i in range(3)] == brute_repeats(texts, 200)
    assert repeats.repeat_report(make([])).count() == 0
    same = make([long, long], ids=[1, None])
    cleaned = repeats.remove_repeats(same)
    assert cleaned.columns == same.columns and [r["text"] for r in cleaned.collect()] == ["", ""]


def test_digit_passes_order_rows_by_bytes():
    rng = np.random.default_rng(6)
    text = rng.integers(0, 2, (300, 27)).astype(np.uint8) * np.uint8(255)
    text[rng.integers(0, 300, 150)] = text[7]
    text[:, :20] = text[7, :20]
    group = np.sort(rng.integers(0, 4, 300))
    order, prefix = repeats.digit_passes(text, group)
    key = [(group[i], text[i].tobytes()) for i in order]
    assert key == sorted(key) and sorted(order.tolist()) == list(range(300))
    for i in range(1, 300):
        same = next((k for k in range(27) if key[i][1][k] != key[i - 1][1][k]), 27)
        assert prefix[i] == (same if key[i][0] == key[i - 1][0] else -1)


def test_anchors_are_sparse():
    text = sentence(3000).encode()
    row, *_ = repeats.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(text) / 150 < len(row) < len(text) / 40


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(cover)


def test_base_counts_and_bands(make):
    texts = [*EDGES, "a\nb\na\n\na \na", "# * | <b>", "a b c d e f a b c d e", "x\r\nx\r\n" * 3] + [sentence(60) for _ in range(200)] + ["qzj " * 3 + " ".join(w.upper()[::-1] for w in sentence(80).split())]
    found = by_id(perplexity.quality_rules(make(texts, langs={0: None})))
    for i, t in enumerate(texts):
        want = brute_counts(t)
        assert tuple(found[i][c] for c in perplexity.COUNTS) == want
        assert found[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (found[i]["base_failed"] and found[i]["kept"])
    clean = [i for i in range(len(EDGES) + 4, len(texts) - 1)]
    assert all(found[i]["kept"] for i in clean) and not found[len(texts) - 1]["kept"]
    assert perplexity.quality_rules(make([])).count() == 0


def test_bands_are_of_each_language_and_have_two_ends(make):
    rng = random.Random(12)
    say = lambda chars, n: " ".join("".join(rng.choice(chars) for _ in range(rng.randint(3, 7))) for _ in range(n))
    texts = [say("abcdefgh", 80) for _ in range(80)] + [say("йцукенгш", 80) for _ in range(80)]
    texts += [say("mnopqrst", 80), say("|#*$%~^@", 80), "abcde " * 9 + "bcdef ghabc defgh aabbc cdeef fghha hgfed dcbaa", say("abcdefgh", 80)]
    langs = {i: "ru" if 80 <= i < 160 or i == 163 else "en" for i in range(len(texts))}
    found = by_id(perplexity.quality_rules(make(texts, langs=langs)))
    assert all(found[i]["kept"] for i in range(160))
    assert [found[i]["kept"] for i in (160, 161, 163)] == [False] * 3  # other letters, symbols, another language's text


def brute_kneser_ney(texts):
    """Probability of each 4-gram's last character, with grams of one text alone pruned."""
    marked = ["\x02" * 3 + t for t in texts]
    count = {4: Counter(g for t in marked for g in {t[i : i + 4] for i in range(len(t) - 3)})}
    kept = {4: {g for g, c in count[4].items() if c >= 2}}
    for n in (3, 2, 1):
        count[n] = Counter({g[1:]: 0 for g in count[n + 1]})
        count[n].update(g[1:] for g in kept[n + 1])
        kept[n] = {g for g, c in count[n].items() if c > 0}
    p = {0: {"": perplexity.UNSEEN}}
    for n in (1, 2, 3, 4):
        t = [max(1, sum(c == k for c in count[n].values())) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        cut = [0, *(min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))]
        total, mass, p[n] = Counter(), Counter(), {}
        for g, c in count[n].items():
            total[g[:-1]] += c
            mass[g[:-1]] += c - cut[min(c, 3)] if g in kept[n] else 0
        for g, c in count[n].items():
            own = c - cut[min(c, 3)] if g in kept[n] else 0
            h = g[:-1]
            p[n][g] = (own / total[h] + (1 - mass[h] / total[h]) * p[n - 1][g[1:]]) if total[h] else p[n - 1][g[1:]]
    return p[4]


def test_log_perplexity_equals_brute_force(make, monkeypatch):
    monkeypatch.setattr(perplexity, "BLOCK_BYTES", 300)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS[:40]) for _ in range(30)) for _ in range(40)] + ["éé日本 x", "ab", "a", "🙂🙂 b", None, ""]
    langs = {i: "de" if i % 3 == 0 else "en" for i in range(len(texts))}
    found = by_id(perplexity.scored(make(texts, langs=langs)))
    fold = lambda t: "".join(c if c < "\U00010000" else chr(0xD800 + int(perplexity.mix(np.array([ord(c)], np.uint64))[0] & np.uint64(0x7FF))) for c in t or "")
    for lang in ("de", "en"):
        mine = [i for i in range(len(texts)) if langs[i] == lang]
        p = brute_kneser_ney([fold(texts[i]) for i in mine])
        for i in mine:
            t = "\x02" * 3 + fold(texts[i])
            want = -np.mean([np.log(p[t[k : k + 4]]) for k in range(len(t) - 3)]) if texts[i] else None
            assert found[i]["log_perplexity"] == (None if want is None else pytest.approx(want, rel=1e-5)), i


def test_kneser_ney_is_a_distribution(spark):
    """Kept grams and the back-off weight share out all of a context's probability."""
    texts = [sentence(40) for _ in range(30)]
    count = Counter()
    for t in texts:
        gram, at = perplexity.grams(*raw(pa.array([t])))
        count.update(dict(zip(*(x.tolist() for x in perplexity.texts_with(gram, at)), strict=True)))
    rows = spark.createDataFrame([("x", g - (1 << 64) if g >> 63 else g, n) for g, n in count.items()], "lang string, gram bigint, c bigint")
    p = {r["gram"] % (1 << 64): r["p"] for r in perplexity.kneser_ney(rows).collect()}
    assert set(p) == set(count) and all(0 < x <= 1 for x in p.values())
    by_context = {}
    for g, x in p.items():
        by_context[g >> 16] = by_context.get(g >> 16, 0) + x
    assert all(x <= 1 + 1e-9 for x in by_context.values()) and max(by_context.values()) > 0.9


def test_shards_part_over_the_buckets(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate((rng.integers(0, 1 << 62, 50), [0, 1, 1 << 40]))
    rows = spark.createDataFrame([(int(v),) for v in values], "v bigint").selectExpr("v", "pmod(hash(v), 13) AS b").collect()
    assert [r["b"] for r in rows] == perplexity.bucket_of(np.array([r["v"] for r in rows]), 13).tolist()
    numbers = np.array([perplexity.shard_number(p, t, 40) for p in range(20) for t in range(2)])
    assert len(set(numbers.tolist())) == 40 and len(set(perplexity.bucket_of(numbers, 40).tolist())) >= 39


def test_hash_array_finds_what_it_holds():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5000):
        key = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        found = perplexity.HashArray(key, np.arange(len(key), dtype=float))
        assert (found(key) == np.arange(len(key))).all()
        assert np.isnan(found(rng.integers(1 << 62, 1 << 63, 100).astype(np.uint64))).all()


def test_texts_with_counts_each_text_once():
    texts = ["abab abab", "ab", "", "xabab", "日本日本日本"]
    gram, at = perplexity.grams(*raw(pa.array(texts)))
    got = dict(zip(*(x.tolist() for x in perplexity.texts_with(gram, at)), strict=True))
    want = Counter(g for t in texts for g in {("\x02" * 3 + t)[i : i + 4] for i in range(len(t))})
    assert got == {sum(ord(c) << 16 * (3 - k) for k, c in enumerate(g)): n for g, n in want.items()}


def two_languages(n=60):
    a = ["ing the and was " + " ".join(random.choice(["thing", "other", "being", "with"]) for _ in range(30)) for _ in range(n)]
    b = ["der die und ist " + " ".join(random.choice(["sche", "keit", "lich", "ung"]) for _ in range(30)) for _ in range(n)]
    return a, b


def test_language_field(make):
    a, b = two_languages()
    mixed = " ".join(a[0].split() + b[0].split() * 3)
    texts = [*a, *b, mixed, *EDGES, "12 ... 34"]
    langs = {i: ("en" if i < len(a) else "de" if i < len(a) + len(b) else None) for i in range(len(texts))}
    docs = make(texts, langs=langs)
    found = by_id(language.languages(docs, language.fit(docs)))
    assert all(found[i]["lang_pred"] == langs[i] and 0.5 < found[i]["score"] <= 1 for i in range(len(a) + len(b)))
    at = len(a) + len(b)
    assert found[at]["lang_pred"] == "de" and found[at]["score"] < 0.9
    for i in (at + 1, at + 2, at + 3, len(texts) - 1):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    empty = make([])
    assert language.languages(empty, language.fit(empty)).count() == 0
    assert language.languages(make(["abc"], langs={0: None}), None).head()["lang_pred"] == "und"


def test_spans_of_code_switched_text(make):
    a, b = two_languages()
    field = language.train(a + b, ["en"] * len(a) + ["de"] * len(b))
    texts = [a[0] + ". 12 " + b[0] + "; " + a[1], "é!", "", None, "..."]
    spans = {}
    for r in language.language_spans(make(texts), field).orderBy("doc_id", "start").collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["stop"], r["lang"]))
        assert 0 < r["score"] <= 1
    first, second = len(a[0]), len(a[0]) + len(". 12 ")
    assert [x[2] for x in spans[0]] == ["en", "de", "en"] and set(spans) == {0, 1}
    assert abs(spans[0][0][1] - first) < 12 and abs(spans[0][1][0] - second) < 12 and spans[0][2][1] == len(texts[0])
    assert language.language_spans(make(texts), None).count() == 0


def test_passages_share_the_attention(make):
    model = quality.Attention()
    found = by_id(quality.passage_weights(make([sentence(150), "x", None]), model))
    assert [len(found[i]["weights"]) for i in range(3)] == [3, 1, 1] and all(abs(sum(r["weights"]) - 1) < 1e-6 for r in found.values())


def test_every_language_is_learned(make):
    rng = random.Random(2)
    stems = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for i in range(70)}
    texts, langs = [], {}
    for lang, words_ in stems.items():
        for _ in range(6):
            langs[len(texts)] = lang
            texts.append(" ".join(rng.choice(words_) for _ in range(40)))
    langs[len(texts)] = "long"  # a language of long and repeated texts only
    texts.append("umpa lumpa dumpa " * 40_000)
    docs = make(texts, langs=langs)
    docs = docs.union(docs.filter("lang = 'long'").selectExpr("doc_id + 1 as doc_id", "text", "lang", "source", "n_chars", "node", "bands", "queue", "score"))
    field = language.fit(docs)
    assert len(field.labels) == 71
    found = by_id(language.languages(docs, field))
    assert all(found[i]["lang_pred"] == lang for i, lang in langs.items())


def test_forward_backward_is_exact():
    import itertools

    rng = np.random.default_rng(0)
    emission, row = rng.normal(size=(11, 3)), np.array([0] * 6 + [2] * 5)
    start, move = rng.normal(size=3), rng.normal(size=(3, 3))
    for segment in (1, 2, 4, 64):
        p, _ = language.posteriors(emission, row, 4, start, move, segment)
        for r in (0, 2):
            e, want = emission[row == r], np.zeros((int((row == r).sum()), 3))
            for y in itertools.product(range(3), repeat=len(e)):
                w = np.exp(start[y[0]] + sum(e[i, v] for i, v in enumerate(y)) + sum(move[u, v] for u, v in itertools.pairwise(y)))
                want[np.arange(len(e)), y] += w
            assert np.allclose(want / want.sum(1, keepdims=True), p[row == r])


def test_language_prediction_equals_a_plain_field(make):
    """Features word by word, and forward-backward a text at a time."""
    a, b = two_languages(30)
    field = language.train(a + b, ["en"] * 30 + ["de"] * 30)
    hashed = lambda x: language.Prefixes(np.frombuffer(x, np.uint8))(np.array([0]), np.array([len(x)]))[0]
    salt, top = language._SALT, np.uint64(64 - language.BITS)

    def weights(word):
        own = hashed(word)
        keys = [own + salt[0]]
        for k in range(1, min(4, len(word)) + 1):
            keys += [hashed(word[:k]) + salt[k], hashed(word[-k:]) + salt[4 + k]]
        keys += [hashed(word[i : i + 3]) + salt[9] for i in range(len(word) - 2)]
        known = [int(x) for k, x in zip(field.lexicon.keys, field.lexicon.label, strict=True) if k == own]
        keys += [np.uint64(x) + salt[10] for x in known]
        return sum(field.weights[int(language.mix(np.array([k], np.uint64))[0] >> top)].astype(float) for k in keys)

    texts = [a[0] + " " + b[1], "Thing sche 12 ÉTé x", b[2][:20], "a"]
    mean, count, sure = field.predict(*raw(pa.array(texts)))
    for t, got, n, certain in zip(texts, mean, count, sure, strict=True):
        low = "".join(c.lower() if ord(c) < 256 else c for c in t)
        e = np.array([weights(w) for w in re.findall(rb"[a-zA-Z\x80-\xff]+", low.encode())])
        move, back = np.exp(field.transition), np.ones((len(e), 2))
        ahead = np.zeros((len(e), 2))
        for i in range(len(e)):
            ahead[i] = (np.exp(field.start) if i == 0 else ahead[i - 1] @ move) * np.exp(e[i] - e[i].max())
            ahead[i] /= ahead[i].sum()
        for i in range(len(e) - 2, -1, -1):
            back[i] = move @ (np.exp(e[i + 1] - e[i + 1].max()) * back[i + 1])
            back[i] /= back[i].sum()
        p = ahead * back / (ahead * back).sum(1, keepdims=True)
        assert n == len(e) and np.allclose(got, p.mean(0), atol=1e-5) and abs(certain - p.max(1).mean()) < 1e-5


def test_passage_scores_equal_plain_loops():
    rng = np.random.default_rng(3)
    model = quality.Attention()
    model.mean, model.scale = rng.normal(size=quality.N_FEATURES).astype(np.float32), rng.uniform(0.5, 2, quality.N_FEATURES).astype(np.float32)
    texts = [sentence(150), "One two. Three!! four", ""]
    x, owner = quality.passages(*raw(pa.array(texts)))
    assert owner.tolist() == [0, 0, 0, 1, 2]
    w, squash, sigmoid = model.w, np.tanh, lambda v: 1 / (1 + np.exp(-v))
    for i in range(3):
        h = [squash(((r - model.mean) / model.scale) @ w["A"] + w["b"]) for r in x[owner == i].astype(float)]
        e = [np.exp(w["w"] @ (squash(v @ w["V"]) * sigmoid(v @ w["U"]))) for v in h]
        z = sum(a * v for a, v in zip(e, h, strict=True)) / sum(e)
        assert abs(model.score(x, owner, 3)[i] - sigmoid(z @ w["c"] + w["d"][0])) < 1e-4
    hashed = lambda b: quality.Prefixes(np.frombuffer(b, np.uint8))(np.array([0]), np.array([len(b)]))[0]
    want, n = np.zeros(quality.BUCKETS), 0
    for word in texts[1].encode().split():
        for key, salt in [(word, 0)] + [(word[i : i + 4], 1) for i in range(len(word) - 3)]:
            k = int(quality.mix(np.array([hashed(key) + quality._SALT[salt]], np.uint64))[0])
            want[k % quality.BUCKETS] += 1 - 2 * (k >> 63)
            n += 1
    assert np.allclose(x[3, quality.N_FORM :], want / np.sqrt(n), atol=1e-6)


def test_quality_attention(make, spark):
    good = [sentence(120) for _ in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(120).split()) for _ in range(40)] + ["Erst, " * 150] * 10
    texts = [*good, *bad, *EDGES]
    docs = make(texts)
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(130)] + [(0, 0, 0), (1, 7, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = by_id(quality.qualities(docs, quality.fit(docs, labels)))
    right = sum((found[i]["score"] >= 0.3) == (i < 80) for i in range(130))
    assert right >= 126 and all(0 <= r["score"] <= 1 for r in found.values()) and len(found) == len(texts)
    assert found[130]["score"] == found[131]["score"]
    assert quality.fit(docs, labels.limit(0)) == 0.5 and quality.qualities(make([]), 0.5).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(1)
    model = quality.Attention()
    x, owner, y, w = rng.normal(size=(7, quality.N_FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0, 1]), np.ones(3) / 3

    def loss():
        z = model.forward(x, owner, 3)["logit"]
        return float((w * (np.logaddexp(0, z) - y * z)).sum())

    grad = model.gradient(x, owner, y, w)
    for name, g in grad.items():
        at = tuple(0 for _ in g.shape)
        keep = model.w[name][at]
        model.w[name][at] = keep + 1e-5
        up = loss()
        model.w[name][at] = keep - 1e-5
        down = loss()
        model.w[name][at] = keep
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5, name
