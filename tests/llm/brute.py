"""Plain single-machine versions of corpus operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from loomlake.llm import dedup, langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def repeats(w):
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})


def quality_kept(rows):
    """Whether each of the rows (dicts) is kept by the base rules and its group's fences."""
    measured = []
    for r in rows:
        w, text = words(r["text"]), r["text"] or ""
        lines = [x for x in text.split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        failed = len(w) < 10 or 100 * repeats(w) > 20 * len(w)
        sym = min(200 * len(re.findall(r"[#*$%&|<>]", text)) // chars, 200) if chars else None
        dup = min(50 * (len(lines) - len(set(lines))) // len(lines), 50) if lines else None
        measured.append((failed, {"sym": sym, "dup": dup, "wlen": min(10 * (chars + 100) // (len(w) + 20), 255)}))
    groups = defaultdict(list)
    for r, (failed, m) in zip(rows, measured, strict=True):
        if not failed:
            for name, x in m.items():
                if x is not None:
                    groups[r["lang"], r["source"], name].append(x)

    def fence(values, least):
        values = sorted(values)
        at = lambda pct: values[math.ceil(pct * len(values) / 100) - 1]
        return at(50) + max(least, 4 * (at(50) - at(10)))

    fences = {k: fence(v, {"sym": 6, "dup": 20, "wlen": 15}[k[2]]) for k, v in groups.items()}
    over = lambda r, m: any(x is not None and x > fences[r["lang"], r["source"], name] for name, x in m.items())
    return [not failed and not over(r, m) for r, (failed, m) in zip(rows, measured, strict=True)]


def languages(rows):
    """(language, probability) of each row: naive Bayes over all character 1- to 3-grams, counted one by one."""

    def grams(text):
        codes = np.frombuffer((" " + text.lower().replace("\0", " ") + " \0").encode("utf-32-le", "surrogatepass"), np.uint32)
        return Counter(x for g in langid.grams(codes) for x in g.tolist())

    import zlib

    counts, n = defaultdict(Counter), Counter()
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2):
            counts[r["lang"]].update(grams(r["text"]))
            n[r["lang"]] += 1
    out = []
    for r in rows:
        if not n or not r["text"] or not re.search(r"[^\W\d_]", r["text"]):
            out.append(("und", 0.0))
            continue
        score = {}
        for lang in sorted(n):
            total = counts[lang].total() + 0.5 * langid.BUCKETS
            score[lang] = math.log(n[lang] / n.total()) + sum(k * math.log((counts[lang][g] + 0.5) / total) for g, k in grams(r["text"]).items())
        best = max(score, key=score.get)
        out.append((best, 1 / sum(math.exp(s - score[best]) for s in score.values())))
    return out


def classes(rows):
    """The class of each row with words: the smallest doc_id that pairs of 0.8 or more lead to, every pair compared."""
    runs = []
    for r in rows:
        h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words(r["text"])], np.uint64).view(np.int64)
        runs.append(dedup.shingles(h, np.array([len(h)]))[1:])
    bucket = lambda ids: (ids & np.uint64((1 << dedup.DF_BITS) - 1)).astype(int)
    df, n = np.zeros(1 << dedup.DF_BITS), 0
    for ids, _ in runs:
        np.add.at(df, bucket(ids), 1)
        n += len(ids) > 0
    weights = 1 + dedup.DAMP * np.clip(np.log2((n + 1) / (df + 1)), 0, 8) / 8
    weighted = [dict(zip(ids.tolist(), (count * weights[bucket(ids)]).tolist(), strict=True)) for ids, count in runs]
    at = [i for i, x in enumerate(weighted) if x]
    comp = list(range(len(rows)))
    for i in at:
        for j in at:
            if i < j and comp[i] != comp[j]:
                a, b = weighted[i], weighted[j]
                if min(len(a), len(b)) < 0.5 * max(len(a), len(b)) and min(sum(a.values()), sum(b.values())) < 0.79 * max(sum(a.values()), sum(b.values())):
                    continue
                shared = sum(min(w, b[k]) for k, w in a.items() if k in b)
                if shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared):
                    comp = [comp[i] if c == comp[j] else c for c in comp]
    least = {}
    for i in at:
        if rows[i]["doc_id"] is not None:
            least[comp[i]] = min(rows[i]["doc_id"], least.get(comp[i], rows[i]["doc_id"]))
    return [least.get(comp[i]) if weighted[i] else None for i in range(len(rows))]


def mix_times(rows):
    """How many times the mix takes each row; shares of a full source are dealt again until none is above its cap."""
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_, target, budget = set(order), {}, 1.5 * sizes.total()
    while open_:
        rate = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else weight[s] * rate
            budget -= target[s]
        open_ -= full or open_
    key = lambda r: int(hashlib.md5(("~" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16)
    times = [0] * len(rows)
    for s in order:
        mine = [i for i, r in enumerate(rows) if r["source"] == s]
        copies = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, used = target[s] - copies * sizes[s], 0
        ties = defaultdict(list)
        for i in mine:
            times[i] = copies
            ties[key(rows[i])].append(i)
        for h in sorted(ties):
            n = sum(len(words(rows[i]["text"])) for i in ties[h])
            if rest <= 0 or (used + n > rest and n >= 2 * (rest - used)):
                break
            for i in ties[h]:
                times[i] += 1
            used += n
            if used > rest:
                break
    return times
