"""Language-model scores, Merkle manifests and spelling variants against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomlake.llm import lm, merkle, ppm, variants

DOCS = "doc_id long, source string, lang string, n_chars long, text string, n int, gram string, pos long, word string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcéÀz") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    rows = [(i, rng.choice(["s", None]), rng.choice(["en", "de", "é", None]), i % 7, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))).title()) for i in range(120)]
    rows += [(None, None, None, None, None), (500, "s", "en", 0, ""), (501, "s", "", 3, " \n\t"), rows[3], rows[3], rows[3], (502, "s", "en", 1, "Word\x00 wörds " * 9000), (503, "s", "xx", 1, "same"), (504, "s", "xx", 1, "same")]
    return rows


def _ppm(texts, train):
    """log10 of the probability of each text, from counts of every context in dictionaries."""
    seen = defaultdict(Counter)
    sequences = [[ppm.BEGIN] * ppm.DEPTH + [*t, ppm.END] for t in texts]
    for s, use in zip(sequences, train, strict=True):
        for i in range(ppm.DEPTH, len(s)) if use else ():
            for k in range(ppm.DEPTH + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    known = {}

    def one(context, symbol):
        p, gone = 1.0, set()
        for k in range(ppm.DEPTH, -1, -1):
            left = {x: n for x, n in seen.get(context[ppm.DEPTH - k :], {}).items() if x not in gone}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return math.log10(p * left[symbol] / total)
            p *= len(left) / total
            gone |= set(left)
        return math.log10(p / (ppm.SYMBOLS - len(gone)))

    out = []
    for s in sequences:
        logs = []
        for i in range(ppm.DEPTH, len(s)):
            key = (tuple(s[i - ppm.DEPTH : i]), s[i])
            if key not in known:
                known[key] = one(*key)
            logs.append(known[key])
        out.append(math.fsum(logs))
    return out


def _scores(rows):
    texts = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", (r[4] or "").translate(LOWER))).encode() for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    tokens = [[*t.split(), None] for t in texts]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n = sum(counts.values())
    base = [math.fsum(math.log10((counts[w] + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in t) for t in tokens]
    score = _ppm(texts, [not h for h in held])
    return [(r[0], h, len(t), sum(counts[w] > 0 for w in t), n, round(b, 5), round(s, 5)) for r, h, t, b, s in zip(rows, held, tokens, base, score, strict=True)]


def _text(rows):
    return sorted(map(str, rows))


def test_scores_equal_a_plain_model(spark, odd):
    assert _text((*r[:5], round(r[5], 5), round(r[6], 5)) for r in lm.score(_docs(spark, odd)).collect()) == _text(_scores(odd))


def test_scores_of_the_documents_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    rows = [(r["doc_id"], None, None, None, r["text"]) for r in docs.collect()]
    got = lm.score(docs).collect()
    assert _text((*r[:5], round(r[5], 5), round(r[6], 5)) for r in got) == _text(_scores(rows))


def test_scores_without_training_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = lm.score(_docs(spark, [(held, None, None, None, "ab c")])).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["score"] == pytest.approx(-5 * math.log10(ppm.SYMBOLS))
    assert lm.score(_docs(spark, [])).count() == 0


def test_chunks_of_the_trie_give_the_same_lengths():
    """Contexts that lie in several chunks are whole again at each."""
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"aab bc"), 400)) for _ in range(20)]
    keys, n = ppm.counted(np.concatenate([k for k, _, _ in ppm.packed(texts)]), np.ones(sum(map(len, texts)) + 20, np.int64))
    n[rng.random(len(n)) < 0.2] = 0
    want = ppm.code_lengths(keys, n)
    for size in (1, 7, 100):
        given = {order: tuple(x[c > 0] for x in (p, c)) for order in range(ppm.DEPTH + 1) for p, c in [ppm.nodes(keys, n, order)]}
        got = []
        for at in range(0, len(keys), size):
            part = keys[at : at + size]
            edges = {o: tuple(x[np.isin(p >> np.uint64(8), ppm.prefix(part[[0, -1]], o))] for x in (p, c)) for o, (p, c) in given.items()}
            got.append(ppm.code_lengths(part, n[at : at + size], edges))
        assert np.allclose(np.concatenate(got), want)


def test_probabilities_of_a_context_sum_to_one():
    texts = [b"abracadabra", b"abrab", b"xyz"]
    keys, _ = ppm.counted(np.concatenate([k for k, _, _ in ppm.packed(texts)]), np.ones(sum(map(len, texts)) + 3, np.int64))
    for context in (keys[5], keys[-1], np.uint64(0)):
        high = context >> np.uint64(8) << np.uint64(8)
        every = high | np.array([x for x in range(256) if x != ppm.BEGIN], np.uint64)
        both, n = ppm.counted(np.append(keys, every), np.append(np.ones(len(keys), np.int64), np.zeros(len(every), np.int64)))
        p = 10 ** ppm.code_lengths(both, n)
        assert p[np.isin(both, every)].sum() == pytest.approx(1)


def test_tally_and_lookup():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 5000, 60_000).astype(np.uint64) << np.uint64(20)
    tally = ppm.Tally()
    for part in np.array_split(keys, 5):
        tally.add(part, 1)
    tally.add(np.array([1, 0], np.uint64), 0)
    got = dict(zip(*map(list, tally.done()), strict=True))
    assert got == Counter(keys.tolist()) | {1: 0, 0: got[0]}
    found, n = tally.done()
    assert (ppm.Lookup(found, n)(keys) == [got[k] for k in keys.tolist()]).all()


def _hex(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(row):
    return _hex("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_hex("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def _manifest(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    keys = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    for own in langs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = {k: _tree([_leaf(r) for r in langs[k]]) for k in keys}
    top = _tree([trees[k][-1][0] for k in keys])
    root = top[-1][0]
    for at, k in enumerate(keys):
        for i, r in enumerate(langs[k]):
            new = _leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                new = _leaf((*r[:4], r[4] and r[4].translate(LOWER)))
            proof = ""
            for levels, place in ((trees[k], i), (top, at)):
                for level in levels[:-1]:
                    run, slot = level[place // 8 * 8 : place // 8 * 8 + 8], place % 8
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    new = _hex("".join([*run[:slot], new, *run[slot + 1 :]]))
                    place //= 8
            yield r[0], _leaf(r), trees[k][-1][0], root, _hex(proof), new, new == root


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest_equals_a_plain_tree(spark, odd, levels):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in odd]
    got = merkle.manifest(_docs(spark, rows), levels=levels).collect()
    assert _text(map(tuple, got)) == _text(_manifest(rows))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(6, "s", "en", 3, "aBc")]
    assert _text(map(tuple, merkle.manifest(_docs(spark, rows)).collect())) == _text(_manifest(rows))
    assert merkle.manifest(_docs(spark, [])).count() == 0


def test_many_equal_rows_and_many_languages(spark):
    rows = [(1, "s", "en", 1, "AbC")] * 700 + [(i, None, f"l{i}", 0, None) for i in range(90)]
    assert _text(map(tuple, merkle.manifest(_docs(spark, rows), levels=2).collect())) == _text(_manifest(rows))


def test_folding_resumes_states():
    children = [_hex(str(i)).encode() for i in range(8)]
    node = merkle.Node(children)
    for slot in range(8):
        changed = [*children[:slot], b"x" * 64, *children[slot + 1 :]]
        assert node.folded(slot, b"x" * 64).decode() == hashlib.sha256(b"".join(changed)).hexdigest()
    assert node.digest.decode() == hashlib.sha256(b"".join(children)).hexdigest()


def _variants(rows):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[4] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    neighbours = {w: [x for x in words if near(w, x)] for w in words}
    form = {w: f for w, around in neighbours.items() if around and words[f := min(around, key=lambda x: (-words[x], x))] >= 5 * words[w]}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, words[w], len(neighbours[w]), words[form[w]] if w in form else None


@pytest.fixture(scope="module")
def spelt(odd):
    rows = [*odd, (700, None, None, 0, "abcdefg " * 5 + "abcdef " * 30 + "ABCDEFÉ " * 6 + "abcdeé " * 200), (701, None, None, 0, "abbcde aabcde " * 9 + "abcdxf×÷ÿ " * 8)]
    return rows + [(702, None, None, 0, "x" * 3000 + " " + "x" * 2999)] * 5


def test_variants_equal_all_pairs(spark, spelt):
    want = _text(_variants(spelt))
    assert _text(map(tuple, variants.group(_docs(spark, spelt)).collect())) == want
    assert variants.group(_docs(spark, [])).count() == 0


def test_variants_in_many_passes(spark, spelt, monkeypatch):
    """Filters of a few bytes: many passes, lengths cut by hash, and hardly a probe that isn't positive."""
    monkeypatch.setattr(variants, "PASS_BYTES", 64)
    monkeypatch.setattr(variants, "BITS", 8)
    assert len(variants.passes({6: 100, 7: 10})[0]) > 1 and variants.passes({6: 100, 7: 10})[1][6] > 1
    assert _text(map(tuple, variants.group(_docs(spark, spelt)).collect())) == _text(_variants(spelt))


def test_edits_hash_as_their_texts():
    letters = [chr(int(x)) for x in variants.LETTERS]
    for word in ("abbacé", "zzzzzz", "ÿabcde"):
        made = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters if c > word[i]}
        got = np.concatenate([h for h, _, _ in variants.edits(word)]).tolist()
        assert sorted(got) == sorted(variants.poly(variants.codes(w)) for w in made)
