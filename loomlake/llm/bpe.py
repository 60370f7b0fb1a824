"""BPE encoding and decoding by a bounded-lookahead streaming transducer (operator 9).

The vocabulary is a tokenizer file in JSON: merges with an end-of-word suffix over byte characters,
after NFC, white space folding and lower case; its path is a parameter and tasks read it once each.

Encoding: a text is normalised piece by piece and cut into words in order. Every word goes through a
transducer in steps of STEP characters: it holds a buffer, merges it, and emits a token once nothing that
may follow can change it, that is, once the token's own lookahead is known. These lookaheads follow from
the merge list alone: going through the merges by rank, they bound how far to the right the presence of
each symbol can depend on the text. A word may go on over any number of pieces, so memory is bounded by
the piece, the longest lookahead and the longest token. A table of bounded size remembers the
transducer's output for words of ordinary length.

Decoding: a state machine takes the bytes of token after token and gives text as soon as characters are
complete; its state is the bytes of an unfinished character and whether a token went before.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import math
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "word_bpe_49k.json"
#: Words whose output is remembered (twice so many at most), and the longest of them.
CACHE_WORDS, CACHE_LENGTH = 80_000, 64
#: Characters that are normalised and cut into words at once, and that the transducer takes in one step.
PIECE, STEP = 1 << 16, 512
#: Longer lists of symbols are merged by a heap.
SHORT = 48

# White space of Unicode, and the words of this vocabulary's kind: endings after an
# apostrophe, runs of letters, single numbers, runs of anything else.
_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"

# The letters and numbers that Unicode 16 added to those of Python's tables (15.1); the
# vocabulary's library has them, and none of later versions.
_L16 = (
    "\\u1c89-\\u1c8a\\ua7cb-\\ua7cd\\ua7d2\\ua7d4\\ua7da-\\ua7dc\\U000105c0-\\U000105f3\\U00010d4a-\\U00010d65\\U00010d6f-\\U00010d85\\U00010ec2-\\U00010ec4\\U00011380-\\U00011389\\U0001138b\\U0001138e"
    "\\U00011390-\\U000113b5\\U000113b7\\U000113d1\\U000113d3\\U00011bc0-\\U00011be0\\U00013460-\\U000143fa\\U00016100-\\U0001611d\\U00016d40-\\U00016d6c\\U00018cff\\U0001e5d0-\\U0001e5ed\\U0001e5f0"
)
_N16 = "\\U00010d40-\\U00010d49\\U000116d0-\\U000116e3\\U00011bf0-\\U00011bf9\\U00016130-\\U00016139\\U00016d70-\\U00016d79\\U0001ccf0-\\U0001ccf9\\U0001e5f1-\\U0001e5fa"


def _class(kind: str, added: str) -> str:
    """The characters of a general category, as ranges of a pattern."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if after != c + 1]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + added


_L, _N = _class("L", _L16), _class("N", _N16)
_WORDS = regex.compile(rf"[{_L}]+|{_ENDINGS}|[{_N}]|[^{_SPACE}{_L}{_N}]+")
#: The same for texts in which every number is a decimal digit.
_SIMPLE = re.compile(rf"[^\W\d_]+|{_ENDINGS}|\d|(?:[^\w{_SPACE}]|_)+")
_ODD_NUMBERS = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No"))
#: Scripts to which later versions of Unicode than that of re may have added letters.
_LATER = re.compile("[\u0870-\U0010ffff]")
# Small letters of the capitals that Unicode 16 and 17 added.
_LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_LETTERS, _OTHERS = regex.compile(rf"[{_L}]*"), regex.compile(rf"[^{_SPACE}{_L}{_N}]*")
_LAST_SPACE = regex.compile(rf"(?r)[{_SPACE}]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for k, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(256 + k)
    return [table[b] for b in range(256)]


class Vocabulary:
    """Token ids, merge ranks and the sufficient lookahead of every symbol of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.far = self._lookaheads(pairs)
        self.lookahead = max(self.far.values(), default=0) + 1
        self.longest = max(map(len, self.ids))
        self.bytes = byte_chars()
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.names = {i: t.encode() for i, t in names.items()}

    def texts(self) -> dict[int, bytes]:
        """The bytes of the text that each token stands for; a word's end is a space."""
        back = {c: b for b, c in enumerate(self.bytes)}
        plain = lambda t: bytes(back[c] for c in t.removesuffix(self.suffix)) + (b" " if self.suffix and t.endswith(self.suffix) else b"")
        return {i: plain(t) for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}

    def _lookaheads(self, pairs: list[tuple[str, str]]) -> dict[str, float]:
        """How many characters after its end the presence of each symbol can depend on.

        This takes merges in the order of their ranks, so each symbol must be made by one merge, before
        those that use it; for a list of another kind every lookahead is infinite (words are held whole).
        """
        made = {u + v: k for k, (u, v) in enumerate(pairs)}
        if len(made) < len(pairs) or any(made.get(t, -1) > k for k, p in enumerate(pairs) for t in p):
            return dict.fromkeys(self.ids, math.inf)
        far: dict[str, float] = dict.fromkeys(self.ids, 0)
        size = lambda t: len(t.removesuffix(self.suffix)) if self.suffix and len(t) > len(self.suffix) else len(t)
        for u, v in pairs:
            fu, fv = far[u], far[v]
            far[u + v] = max(far[u + v], fv, fu - size(v))
            far[u], far[v] = max(fu, size(v) + fv), max(fv, fu - size(v))
        return far

    def merge(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges, lowest rank first and leftmost first among equals."""
        if len(symbols) > SHORT:
            return self._merge_long(symbols)
        rank, none = self.ranks.get, len(self.ranks)
        order = [rank(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while order and (least := min(order)) < none:
            i = order.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del order[i]
            if i < len(order):
                order[i] = rank((symbols[i], symbols[i + 1]), none)
            if i:
                order[i - 1] = rank((symbols[i - 1], symbols[i]), none)
        return symbols


    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same, with a heap of the pairs that can be merged and links between the symbols that are left."""
        rank, n = self.ranks.get, len(symbols)
        at: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p[1]) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(p)) is not None]
        heap = [(r, i, symbols[i], right) for r, i, right in heap]
        heapify(heap)
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i] if at[i] == left else n
            if j >= n or at[j] != right:
                continue  # one of the two has been merged since
            at[i], at[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((at[i], at[k]))) is not None:
                    heappush(heap, (r, i, at[i], at[k]))
            h = before[i]
            if h >= 0 and (r := rank((at[h], at[i]))) is not None:
                heappush(heap, (r, h, at[h], at[i]))
        return [s for s in at if s is not None]


class Transducer:
    """The encoder of one word: feed() characters and get the ids that are final; end() gives the rest."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.held, self.most = vocabulary, "", 0

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        ids, far = self.v.ids, self.v.far
        for at in range(0, len(chars), STEP):
            self.held += chars[at : at + STEP]
            known = len(self.held) - 1  # the last character may yet turn out to end the word
            self.most = max(self.most, known + 1)
            if len(self.held) < STEP:
                continue
            done = 0
            for t in self.v.merge(list(self.held)):
                if done + len(t) + far[t] > known:
                    break
                out.append(ids[t])
                done += len(t)
            self.held = self.held[done:]
        return out

    def end(self) -> list[int]:
        held, self.held = self.held, ""
        return [self.v.ids[t] for t in self.v.merge([*held[:-1], held[-1] + self.v.suffix])] if held else []


class Encoder:
    """Encodes whole texts: special tokens, normal form, words, ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.known: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def _output(self, ids: list[int]) -> tuple[tuple[int, ...], str, bytes]:
        return tuple(ids), " ".join(map(str, ids)), b" ".join([self.v.names[i] for i in ids])

    def _symbols(self, chars: str) -> str:
        table = self.v.bytes
        return "".join([table[b] for b in chars.encode("utf-8", "replace")])

    def _word(self, word: str) -> tuple[tuple[int, ...], str, bytes]:
        """The transducer's output for a word: ids, their text, and the bytes that they decode to."""
        got = self.older.get(word)
        if not got:
            t = Transducer(self.v)
            got = self._output(t.feed(self._symbols(word)) + t.end())
        if len(word) <= CACHE_LENGTH:
            if len(self.known) >= CACHE_WORDS:  # what was not asked for since the last time goes
                self.known, self.older = {}, self.known
            self.known[word] = got
        return got

    def _words(self, piece: str) -> list[tuple[tuple[int, ...], str, bytes]]:
        get, word = self.known.get, self._word  # a table that is full stays in use for this piece
        found = (_SIMPLE if piece.isascii() or not (_LATER.search(piece) or not _ODD_NUMBERS.isdisjoint(piece)) else _WORDS).findall(piece)
        return [get(w) or word(w) for w in found]

    def encode(self, text: str) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        """What the words and special tokens of a text give, some at a time: ids, their text, and the bytes they decode to."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.v.special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [self._output([self.v.special[part]])]
            elif len(part) <= PIECE:
                yield self._words(_lower(part))
            else:
                yield from self._streamed(part)

    def _streamed(self, text: str) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        """A long text piece by piece; a word may go on over any number of pieces."""
        carry, now, goes_on = "", None, _LETTERS
        for piece, last in _normal_pieces(text):
            s, carry = carry + piece, ""
            if now:  # in a word that is longer than a piece
                end = goes_on.match(s).end()
                ids = now.feed(self._symbols(s[:end]))
                if end == len(s) and not last:
                    yield [self._output(ids)] if ids else []
                    continue
                yield [self._output(ids + now.end())]
                s, now = s[end:], None
            if last:
                yield self._words(s)
                continue
            space = _LAST_SPACE.search(s)
            keep = space.end() if space else 0
            if len(s) - keep > PIECE // 4:  # no space for long: what ends before the last word is complete
                found = [m.span() for m in _WORDS.finditer(s, keep)]
                keep = found[-1][0] if found else len(s)
                if len(found) > 1 and found[-1][1] - found[-1][0] < 3 and s[slice(*found[-2])] == "'":
                    keep = found[-2][0]  # these may be the ending of a word
            yield self._words(s[:keep])
            if len(s) - keep > PIECE // 4:
                now, goes_on = Transducer(self.v), _LETTERS if _LETTERS.match(s, keep).end() > keep else _OTHERS
                ids = now.feed(self._symbols(s[keep:]))
                yield [self._output(ids)] if ids else []
            else:
                carry = s[keep:]


class Decoder:
    """Ids back to text, token by token; give() takes the bytes of some tokens, feed() their ids.

    By the rule of a tokenizer file without a decoder the text is the names of the tokens with a space
    between them. readable: the text that the tokens stand for instead. Bytes that are no UTF-8 become
    U+FFFD; end() gives what is left of an unfinished character.
    """

    def __init__(self, vocabulary: Vocabulary, readable: bool = False) -> None:
        self.parts, self.between = (vocabulary.texts(), b"") if readable else (vocabulary.names, b" ")
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def give(self, data: bytes) -> str:
        if not data:
            return ""
        out = self.machine.decode(self.between + data if self.begun else data)
        self.begun = True
        return out

    def feed(self, ids: Iterable[int]) -> str:
        return self.give(self.between.join([self.parts[i] for i in ids]))

    def end(self) -> str:
        return self.machine.decode(b"", True)


def _lower(text: str) -> str:
    """Each character by itself (so without the final form of sigma), after NFC."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    low = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
    return low.translate(_LATER_LOWER) if _LATER.search(low) else low


_joining: set[str] = set()


def _joins(c: str) -> bool:
    """Whether NFC may join the character with one before it: marks, second parts of compositions, vowels and finals of Hangul."""
    if not _joining:
        for x in map(chr, range(sys.maxunicode + 1)):
            parts = unicodedata.decomposition(x).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                _joining.add(chr(int(parts[1], 16)))
        _joining.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    return unicodedata.combining(c) > 0 or c in _joining


def _normal_pieces(text: str) -> Iterator[tuple[str, bool]]:
    """(normalised piece, whether it is the last); pieces begin where NFC joins nothing with what went before."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _joins(text[end]):
            end += 1
        yield _lower(text[at:end]), end >= len(text)
        at = end


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


_loaded: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(Vocabulary(path))
    return _loaded[path]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b["text"]:
                count, ids, back, sep = 0, hashlib.sha256(), hashlib.sha256(), ""
                decoder = Decoder(enc.v)
                for got in enc.encode(text.as_py() or ""):
                    if got:
                        count += sum([len(x[0]) for x in got])
                        ids.update((sep + " ".join([x[1] for x in got])).encode())
                        back.update(decoder.give(b" ".join([x[2] for x in got])).encode())
                        sep = " "
                back.update(decoder.end().encode())
                n.append(count)
                ids_sha.append(ids.hexdigest())
                text_sha.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row.

    A null text counts as empty: no tokens, and the digests of the empty string. Texts of any length,
    and words of any length in them, are encoded whole, a piece at a time. Null doc_ids and repeated
    rows pass through; an empty table gives no rows; other columns are not read.
    """
    slim = docs.select("doc_id", "text")
    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_digests(path or vocabulary_path()), f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str | None = None, readable: bool = False) -> DataFrame:
    """doc_id, ids, decoded for every row: the ids themselves and the text decoded from them (see Decoder).

    Rows are treated as by digests().
    """
    path = path or vocabulary_path()
    slim = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            all_ids, texts = [], []
            for text in b["text"]:
                d = Decoder(enc.v, readable)
                ids = [i for got in enc.encode(text.as_py() or "") for x in got for i in x[0]]
                all_ids.append(ids)
                texts.append(d.feed(ids) + d.end())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded string")
