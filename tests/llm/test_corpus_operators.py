"""Each operator against a brute-force version or an exact round trip, on small tables with odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from html import unescape

import brute
import numpy as np
import pytest
from conftest import rows_of, rows_of_sql
from pyspark.sql import functions as F

from loomlake.llm import bpe, dedup, html, langid, mixing, quality, queries, sharding, topk, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, TEXT2 string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 0, None, "x", "y") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 120))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None])) for i in range(150)]
    rows += [(200, None, "en", "a"), (201, "", None, None), (202, " \n\t ", "de", "b"), (None, "some words without an id", "en", None), (203, "word " * 30000, "en", "a"), rows[0], rows[0], (204, "a b", "en", "b"), (205, rows[5][1], "en", "b"), (206, "###  ***\n###  ***\n\n12 34", "en", "a")]
    return rows, _docs(spark, rows)


def test_sql_queries(spark, sf_dir, duck):
    for name, sql in queries.ORACLE_SQL.items():
        assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, sql), name


@pytest.mark.parametrize("make", [dedup.near_duplicates, quality.score, mixing.mix, sharding.assign, bpe.digests, langid.predict])
def test_empty_documents(spark, make):
    assert make(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("stage", [quality.keep_good, langid.keep_known, dedup.keep_one, mixing.take])
def test_stages_keep_the_columns(spark, odd, stage):
    out = stage(odd[1])
    assert out.schema.names == odd[1].schema.names
    assert out.count() > 0 and stage(_docs(spark, [])).count() == 0


def test_quality_counts(odd):
    rows, df = odd
    want = Counter()
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), brute.repeats(words))] += 1
    got = quality.score(df).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)


def test_quality_rejects_what_stands_out(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeiourst") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)), "en", "a") for i in range(60)] + [(99, " ".join(rng.choice(words) + "%%%" for _ in range(80)), "en", "a")]
    assert {r.doc_id for r in quality.score(_docs(spark, rows)).where("NOT kept").collect()} == {99}


def test_mix_meets_its_targets(odd):
    rows, df = odd
    got = mixing.mix(df).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert len(got) == len(rows) and Counter(r["size"] for r in got) == Counter(size(t) for _, t, *_ in rows)
    by = {r.source_size: r.target for r in got}
    assert math.isclose(sum(by.values()), 1.5 * sum(by), rel_tol=1e-9)
    for s, target in by.items():
        mine = [r for r in got if r.source_size == s]
        assert target <= 2 * s and all(r.taken in (0, r["size"], 2 * r["size"]) for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(r["size"] for r in mine)
    assert sorted(map(tuple, mixing.mix(df).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.take(df).count() == sum(r.taken // r["size"] for r in got if r["size"]) + sum(1 for r in got if not r["size"] and r.taken) + _taken_empty(df, got)


def _taken_empty(df, got):
    """Documents without words count nothing, but are taken like others of their source and hash."""
    return mixing.take(df).where("text IS NULL OR trim(text) = '' OR NOT text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").count()


def test_hypergeometric_law(spark):
    from pyspark.sql import functions as F

    df = spark.range(40_000).select(sharding._hypergeometric(F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 40_000).alias("x"))
    got = {r.x: r["count"] / 40_000 for r in df.groupBy("x").count().collect()}
    for k in range(11):
        want = math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10)
        assert abs(got.get(k, 0) - want) < 1e-3
    big = spark.range(2000).select(sharding._hypergeometric(F.lit(10**9), F.lit(10**9 // 16), F.lit(10**6), (F.col("id") + 0.5) / 2000).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    spread = math.sqrt(10**6 / 16 * 15 / 16)
    assert abs(big[0] - 62500) < 3 * spread / math.sqrt(2000) and abs(big[1] - spread) < 0.1 * spread


def test_the_shuffle_is_uniform(spark):
    """Where a row goes does not depend on where it came from."""
    df = _docs(spark, [(i, str(i), "en", "a") for i in range(8000)]).repartition(4, "doc_id")
    at = {r.doc_id: r.p for r in df.select("doc_id", F.spark_partition_id().alias("p")).collect()}
    got = sharding.assign(df).collect()
    table = Counter((at[r.doc_id], r.shard) for r in got)
    size = Counter(at.values())
    chi = sum((table[p, s] - n / 16) ** 2 / (n / 16) for p, n in size.items() for s in range(16))
    assert 20 < chi < 80  # 45 degrees of freedom
    slots = np.array([(r.doc_id, r.slot + 500 * r.shard) for r in got], float)
    assert abs(np.corrcoef(slots.T)[0, 1]) < 4 / math.sqrt(8000)


def test_shards_are_even_and_gapless(spark, odd):
    rows, df = odd
    got = sharding.assign(df.repartition(5)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(16))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    text = dict((r[0], r[1]) for r in rows)
    assert all(r["size"] == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == (None if text[r.doc_id] is None else zlib.crc32(text[r.doc_id].encode())) for r in got)


def test_bpe_equals_the_library(odd, spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    t = Tokenizer.from_file(path)
    rng = random.Random(5)
    letters = "abcdefghinotsre'!?#&é ÉΣσςİıß́ \t\n\x85\xa0\x1c㎡²½٣日本語🙂ﬁǅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["a" * 3000, "haha" * 900, "x<|endoftext|>y", "it's", None, "é" * 2000]
    texts += [r[1] for r in odd[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(df, path).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def _same_as_library(enc, library, text):
    ids = [i for got in enc.encode(text) for x in got for i in x[0]]
    assert ids == library.encode(text, add_special_tokens=False).ids
    d = bpe.Decoder(enc.v)
    assert "".join(d.feed([i]) for i in ids) + d.end() == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_words_of_any_length(library):
    enc, rng = bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_path())), random.Random(2)
    for n in (1, 2, 12, 13, 64, 65, 1000, 20_000, 100_000):
        for letters in ("abcdefghinotsre", "ab", "'!#?", "é日本語", "ᄀ가ᅡ각é\u0301"):
            _same_as_library(enc, library, "".join(rng.choice(letters) for _ in range(n)))


def test_bpe_in_pieces_of_any_size(library, monkeypatch):
    enc, rng = bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_path())), random.Random(4)
    for piece in (16, 50, 300):
        monkeypatch.setattr(bpe, "PIECE", piece)
        for k in range(150):
            _same_as_library(enc, library, "".join(rng.choice("abré'vestl!  \n²日é́가" if k % 2 else "ab'revstl! ") for _ in range(rng.randint(0, 400))))


def test_transducer_holds_a_bounded_buffer():
    v, rng = bpe.Vocabulary(bpe.vocabulary_path()), random.Random(2)
    bound = v.lookahead + v.longest + bpe.STEP
    word = "".join(rng.choice("abcdefghinotsre") for _ in range(30_000))
    whole = [v.ids[t] for t in v.merge([*word[:3999], word[3999] + v.suffix])]
    for size in (1, 7, 1000):
        t, got = bpe.Transducer(v), []
        for at in range(0, 4000, size):
            got += t.feed(word[at : at + size] if at + size <= 4000 else word[at:4000])
        assert got + t.end() == whole and t.most <= bound
    t = bpe.Transducer(v)
    emitted = len(t.feed(word))
    assert emitted and t.most <= bound and len(t.held) <= bound


def test_every_word_goes_through_the_transducer(monkeypatch):
    seen = []
    feed = bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, chars: (seen.append(chars), feed(self, chars))[1])
    list(bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_path())).encode("a bb ccc! " + "d" * 80))
    assert seen == ["a", "bb", "ccc", "!", "d" * 80]


def test_decoder_is_incremental():
    v = bpe.Vocabulary(bpe.vocabulary_path())
    enc = bpe.Encoder(v)
    ids = [i for got in enc.encode("naïve 日本 🙂!") for x in got for i in x[0]]
    d = bpe.Decoder(v, readable=True)
    out = [d.feed([i]) for i in ids]
    assert "".join(out) + d.end() == "naïve 日本 🙂! "
    half = bpe.Decoder(v, readable=True)
    assert half.give("é".encode()[:1]) == "" and half.give("é".encode()[1:]) == "é" and half.give(b"\xe2") == "" and half.end() == "�"


def test_language_accuracy_and_unknown_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x.lang_pred == x.lang for x in r) >= 0.95 * len(r) and all(0 <= x.score <= 1 for x in r)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in r)


def test_language_of_odd_rows(odd):
    got = {r.doc_id: r for r in langid.predict(odd[1]).collect()}
    assert got[200].lang_pred == got[201].lang_pred == got[202].lang_pred == "und" and got[200].score == 0 and not got[None].held_out


def test_pages_main_text():
    nav = "<nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
    body = "<p>The man and the sea is a story that all of us have read, and it was good for the people who were there &amp; more.</p>" * 2
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body>{nav}<div class='ad'>Buy this now</div><article><h1>A  title</h1>{body}<p>Short.<!-- c --><script>x='</p>'</script></article><div id='comments'><p>I like it</p></div><footer>&copy; us</footer></body>"
    want = "A title " + "The man and the sea is a story that all of us have read, and it was good for the people who were there & more. " * 2 + "Short."
    assert html.main_text(page) == want
    assert html.main_text(page.replace("article>", "div>")).startswith("A title The man")
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""


def _article(page):
    """What stands in the article of a page as the tables have them, by plain cutting."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?p>|</?h1>", inside))
    return " ".join(x for x in parts if x)


def test_pages_of_the_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: _article(r.html) for r in df.collect()}
    for name in ("article", "div"):  # the element's name decides nothing
        got = html.extract(df.withColumn("html", F.regexp_replace("html", "(</?)article>", f"$1{name}>"))).collect()
        assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


PROSE = "The man and the sea is a story that all of us have read, and it was good for the people who were there. "


def test_page_rules_decide(monkeypatch):
    numbers = "<div>" + "".join(f"<p>{k}-{k * 7919} x{k}y {k * 31}</p>" for k in range(200)) + "</div>"
    links = "<ul>" + "".join(f"<li><a href=/{k}>{PROSE}</a></li>" for k in range(3)) + "</ul>"
    page = f"<body>{numbers}<div><h2>Head</h2><p>{PROSE * 3}</p><p>So it is.</p>{links}<p>Short.</p><p>{PROSE * 3}</p></div></body>"
    once = (PROSE * 3).strip()
    assert html.main_text(page) == f"Head {once} So it is. Short. {once}"
    with monkeypatch.context() as m:
        m.setattr(html, "STOP_WORDS", frozenset())
        assert html.main_text(page).startswith("0-0 x0y")
    with monkeypatch.context() as m:
        m.setattr(html, "inherit", lambda found, tree: found)
        assert html.main_text(page) == f"{once} {once}"
    with monkeypatch.context() as m:
        m.setattr(html, "MAX_LINKS", 2)
        assert html.main_text(page).count(PROSE.strip()) == 9


def _random_tree(rng):
    """A page of random containers: its tree, and blocks whose containers' ancestors are known by name."""
    page, path, ancestors = [], [], []
    for _ in range(rng.randint(2, 25)):
        while path and rng.random() < 0.35:
            page.append(f"</{path.pop()[0]}>")
        if rng.random() < 0.4:
            path.append(("section", object()))
            page.append("<section>")
        tag = rng.choice(["div", "li", "h1"])
        page.append(f"<{tag}>word</{tag}>")
        ancestors.append([None, *(x for _, x in path)])
    return html.blocks("".join(page)), ancestors


def test_page_blocks_inherit_like_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        (found, tree), ancestors = _random_tree(rng)
        assert len(found) == len(ancestors)
        for b in found:
            b.label = rng.choice(["", "", "good", "bad"])
        given, n = [b.label for b in found], len(found)
        want = []
        for k, b in enumerate(found):
            if given[k]:
                want.append(given[k])
                continue
            sides = {}
            for name, way in (("left", range(k - 1, -1, -1)), ("right", range(k + 1, n))):
                at = next((j for j in way if given[j]), None)
                if at is None:
                    sides[name] = (0, k + 1 if name == "left" else n - k, True, "bad")
                else:  # how deep the neighbour's container lies, if this block is in it
                    depth = len(ancestors[at]) - 1
                    inside = ancestors[k][: depth + 1] == ancestors[at]
                    sides[name] = (depth if inside else -1, abs(at - k), found[at].tag != b.tag, given[at], at)
            one, two = sides["left"], sides["right"]
            if b.tag == "h1" and len(two) > 4 and (two[0] >= 0 or (ancestors[k][-1] is not None and any(x in ancestors[two[4]] for x in ancestors[k] if x))):
                want.append(two[3])
            elif one[3] == two[3]:
                want.append(one[3])
            else:
                good, bad = (one, two) if one[3] == "good" else (two, one)
                want.append("good" if good[0] >= 0 and (-good[0], *good[1:3]) < (-bad[0], *bad[1:3]) else "bad")
        assert [b.label for b in html.inherit(found, tree)] == want


def test_page_points_like_plain_counting():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice(["the", "and", "Und,", "sea", "boat", "x"]) for _ in range(rng.randint(1, 200))]
        text, marked = " ".join(words), rng.choice([0, 1, 3])
        links = rng.choice([0, len(text) // 2, len(text)])
        share = sum(w.lower().strip(",") in html.STOP_WORDS for w in words) / len(words)
        want = 0
        for limit, value in ((0.1, share), (0.2, share), (70, len(text))):
            want += value >= limit
        if share >= 0.1:
            want += (len(text) >= 200) + 2 * (len(text) >= 500)
        if links > 0.5 * len(text):
            want = -1
        assert html.points(text, links, marked) == want - marked


NAV, FOOT = "<nav><ul><li><a href=/a>Home</a></li></ul></nav>", "<footer>&copy; us and the others of the house</footer>"
STORY = f"<h1>A title</h1><p>{PROSE * 3}</p><p>So it is.</p><p>{PROSE * 2}</p><p>{PROSE * 7}</p>"
TOLD = f"A title {(PROSE * 3).strip()} So it is. {(PROSE * 2).strip()} {(PROSE * 7).strip()}"


@pytest.mark.parametrize("name", ["layout no-sidebar", "has-sidebar", "single-post comments-open", "entry share-enabled", "post widget-area", "form-page", "sidebar-wrapper", "promo"])
def test_class_words_do_not_hide_the_article(name):
    assert html.main_text(f"<body>{NAV}<div class='{name}'>{STORY}</div>{FOOT}</body>") == TOLD
    assert html.main_text(f"<body class='{name}'>{NAV}<div class='{name}'><div><main><div>{STORY}</div></main></div></div>{FOOT}</body>") == TOLD


@pytest.mark.parametrize("name", ["thread", "discussion", "reviews", "replybox", "comments", "c-zone"])
def test_threads_of_readers_stay_out(name):
    items = "".join(f"<div class=item><span>Bob</span><div class=m>Ann, 3 May</div><p>{PROSE * 2}</p></div>" for _ in range(4))
    for thread in (f"<div class='{name}'>{items}</div>", f"<section id='{name}'><h3>Opinions</h3>{items}</section>"):
        assert html.main_text(f"<body>{NAV}<main><div>{STORY}</div>{thread}</main>{FOOT}</body>") == TOLD


def test_adverts_and_notices_in_the_article_stay_out():
    page = STORY.replace("<p>So", "<div class='ad-slot'>Buy the best of all</div><aside>See the other one</aside><p>So")
    assert html.main_text(f"<body>{NAV}<div class=cookie-notice><p>{PROSE}</p></div><article>{page}</article>{FOOT}</body>") == TOLD


def test_pages_of_plain_words():
    assert html.main_text(f"<body>{PROSE * 4}</body>") == (PROSE * 4).strip()
    assert html.main_text(f"<div>{PROSE.strip()}</div>") == PROSE.strip()


def test_rules_of_blocks_matter(monkeypatch):
    """Blocks without any mark that are not the article: links, rows of numbers, lone lines."""
    rows = "<div>" + "".join(f"<div>{k} {k * 7}</div>" for k in range(9)) + "</div>"
    page = f"<body><div><a href=/x>{PROSE}</a></div>{rows}<section>{STORY}</section><div>Page 3 of 9</div></body>"
    assert html.main_text(page) == TOLD
    with monkeypatch.context() as m:  # every block without a mark
        m.setattr(html, "first_pass", lambda found, tree: [setattr(b, "label", "bad" if b.marked else "good") for b in found])
        assert html.main_text(page) != TOLD
    with monkeypatch.context() as m:
        m.setattr(html, "MAX_LINKS", 2)
        assert html.main_text(page) != TOLD


def test_deep_pages_take_linear_memory():
    import tracemalloc

    sizes = []
    for n in (5_000, 50_000):
        tracemalloc.start()
        html.main_text("<div>a " * n)
        sizes.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert sizes[1] < 15 * sizes[0]


def test_odd_pages(spark):
    long = f'<article><p>{PROSE * 3}<img alt="{"z" * 70_000} > LEAK"></p><p>{PROSE * 3000}</p></article>'
    rows = [(1, "u", long, 7, "t"), (1, "u", long, 7, "t"), (None, None, None, None, None), (2, None, "", 1, "t"), (3, "u", "<script>a</p>", 1, "t"), (4, "u", "a < b & c &amp; <!-- -->", 1, "t"), (5, "u", f"<div hidden><p>{PROSE * 5}</p></div><section id=comments><p>{PROSE * 9}</p></section>", 1, "t")]
    got = Counter((r.page_id, r.url, r.text) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect())
    text = f"{(PROSE * 3).strip()} {(PROSE * 3000).strip()}"
    assert got == Counter([(1, "u", text), (1, "u", text), (None, None, ""), (2, None, ""), (3, "u", ""), (4, "u", ""), (5, "u", "")])
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://b.test/x", "same"), (2, "http://a.test/y?q=1", "same"), (3, None, None), (4, "no scheme", ""), (5, "HTTP://Z.test", "uni ü\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://n.test/", "same"), (6, "http://a.test/y?q=1", "x" * 300_000), (1, "http://b.test/x", "same")]
    return rows, spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, refers_to int")


def test_archives_round_trip(spark, pages):
    rows, df = pages
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        again = first[h or ""] != p
        want[(p, len(b), d, "revisit" if again else "response", first[h or ""] if again else None)] += 1
    got = warc.archive(df).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    keys = [(r.url_key, r.captured_at) for r in sorted(got, key=lambda r: r.position)]
    assert keys == sorted(keys) and sorted(r.position for r in got) == list(range(len(rows)))
    assert warc.archive(df.limit(0)).count() == 0


def test_archives_of_blank_lines_and_many_ranges(spark, monkeypatch):
    """Payloads full of what ends a record come back byte by byte, from many archives and ranges."""
    monkeypatch.setattr(warc, "RECORDS", 7)
    monkeypatch.setattr(warc, "RANGE_ROWS", 25)
    rng = random.Random(12)
    rows = [(k, f"http://h{k % 5}.test/{rng.randint(0, 9)}", "".join(rng.choice(["\r\n", "\r", "\n", "x", "é", "WARC/1.1\r\n"]) for _ in range(rng.choice([0, 3, 40, 30_000])))) for k in range(120)]
    got = {r.page_id: r for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for k, _, h in rows:
        assert got[k].payload_bytes == len(h.encode()) and got[k].payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    order = sorted(got.values(), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(120)) and len({r.archive for r in order}) > 15
    assert order == sorted(order, key=lambda r: (r.url_key, r.captured_at, r.page_id))


def test_loser_tree_merges():
    rng = random.Random(4)
    for k in range(9):
        runs = [sorted((rng.randint(0, 30), rng.random()) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.merge(runs)) == sorted(x for r in runs for x in r)


def test_url_rules_and_verdicts(spark):
    base = [f"http://w{i}.example.net/en/{i}" for i in range(40)] + ["http://cheap-pills.example.net/en/1", "http://x.cheappills.net/en/2"]
    odd_urls = [None, "", "nothing", "http://ORG/x", "https://a.org", "https://a.org/", "http://example.org/es/1", "http://sub.example.org/en/12?x#y", "http://a.com/fr/", "http://a.com/de/#", "ftp://host?x", "http://borg/x"]
    rows = list(enumerate(base + odd_urls))
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    want = [("", "", None), ("", "", None), ("", "", None), ("org", "/x", "org/"), ("a.org", "", None), ("a.org", "/", "org/"), ("example.org", "/es/1", "example.org/es/"), ("sub.example.org", "/en/12", "example.org/en/1"), ("a.com", "/fr/", "com/fr/"), ("a.com", "/de/", "com/de/"), ("host", "", None), ("borg", "/x", None)]
    at = len(base)
    assert [(got[at + i].host, got[at + i].path, got[at + i].rule) for i in range(len(want))] == want
    assert got[at + 9].verdict == "block" and got[at + 8].verdict == "allow"
    assert got[40].verdict == got[41].verdict == "block" and {got[i].verdict for i in range(40)} == {"allow"}
    assert got[41].words == ["x", "cheap", "pills", "net"]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_verdicts_equal_brute_force_and_not_the_seeds(spark):
    block = ["free-casino-win", "win-casino", "casino-free-spins", "freecasino", "spins-win-poker"]
    allow = ["city-library", "library-news", "citynews", "news-of-the-city"]
    hosts = [f"{h}{k}.example.net" if "-" not in h else f"{h}-{k}.example.net" for h in allow for k in range(12)] + [f"{h}.w{k}.example.net" for h in block for k in range(6)]
    named = ["win-free-spins.example.net", "ads-library-city-news-library.example.net", "winfree.example.net"]
    rows = [(k, f"http://{h}/en/{'slots' if 'win' in h else 'books'}/{k}?q", "h", "v") for k, h in enumerate(hosts + named)] + [(0, "http://city-library-0.example.net/en/books/0?q", "h", "v"), (None, None, None, None), (990, "http://" + "q" * 5000 + "/" + "long/" * 20_000, "h", "v")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")).collect()
    assert len(got) == len(rows)
    by_host = {r.host: r for r in got}
    used = lambda r: {*r.words, *re.findall("[a-z]+", r.path.lower())} - {*urls._rule_words(), "www", "0"}

    def model(labels):
        counts = [Counter(), Counter()]
        for r, spam in zip(got, labels, strict=True):
            counts[spam].update(used(r))
        p = lambda t, c: math.log((counts[c][t] + urls.SMOOTH) / (counts[c].total() + urls.SMOOTH * urls.BUCKETS))
        prior = math.log((sum(labels) + 1) / (len(labels) - sum(labels) + 1))
        return [prior + sum(p(t, 1) - p(t, 0) for t in used(r)) > 0 for r in got]

    seeded = [not set(r.words).isdisjoint(urls.SEEDS) for r in got]
    want = model(model(seeded))
    assert [r.verdict == "block" for r in got if not r.rule] == [w for w, r in zip(want, got, strict=True) if not r.rule]
    for host, verdict in zip(named, ("block", "allow", "block"), strict=True):  # the seeds alone say the opposite of each
        assert by_host[host].verdict == verdict and (verdict == "block") == set(by_host[host].words).isdisjoint(urls.SEEDS)
    assert by_host["winfree.example.net"].words == ["win", "free", "example", "net"]
    assert by_host["q" * 5000].words == ["q" * 5000] and by_host[""].verdict == "allow"


def test_viterbi_equals_brute_force():
    rng = random.Random(6)
    for _ in range(30):
        label = "".join(rng.choice("ab") for _ in range(9))
        known = {(a, n): -rng.random() * 9 for a in range(9) for n in range(2, 10 - a) if rng.random() < 0.3}
        p = lambda a, n: known.get((a, n), math.log(urls.UNSEEN / 100) + n * math.log(urls.PER_CHAR))  # noqa: B023, E731
        best = max(sum(p(a, b - a) for a, b in zip(c, c[1:])) for m in range(256) for c in [[0, *[i + 1 for i in range(8) if m >> i & 1], 9]])
        at, total = 0, 0.0
        for w in urls.viterbi(label, known, 100):
            total += p(at, len(w))
            at += len(w)
        assert math.isclose(total, best)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(300, 6))
    m[50:60] = m[50]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(m)]
    rows += [(900, None, 1), (1000, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1100, [float("nan")] * 6, 1), (1200, [1.0, 2.0], 1), (1300, [], 1), (None, [1.0] * 6, 1), (0, rows[0][1], 0), (1400, [1e30] * 6, 1), (100, [2.0, -1.0, 0.5, 1.0, 1.0, 0.0], 0), (7, rows[7][1], 2), (7, rows[9][1], 3)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")).collect()
    vec = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda x: max(-(2**63 - 1), min(2**63 - 1, x))
    want = Counter()
    for row, (q, v) in enumerate(vec):
        if q % 100 == 0:  # every other row is a candidate, those with the same id too
            scored = sorted((-clip(sum(a * b for a, b in zip(v, c))), i) for at, (i, c) in enumerate(vec) if at != row and len(c) == len(v))
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:10]))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_top_k_of_huge_components(spark):
    """Finite components whose squares exceed a double neither vanish nor take others with them."""
    rows = [(0, [1.0, 2.0, 3.0]), (1, [0.5, 0.5, 0.5]), (2, [1e160, 0.0, 0.0]), (3, [-2.0, 0.0, 1.0]), (4, [1e300, -1e300, 1e-300]), (5, [-1e308, 1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 2), (0, 2, 1), (0, 3, 3), (0, 4, 4), (0, 5, 5)]
    assert [r.score for r in sorted(got, key=lambda r: r["rank"])] == [2**63 - 1, 512 * (1024 + 2048 + 3072), -2 * 1024 * 1024 + 3072 * 1024, -(2**63 - 1), -(2**63 - 1)]


def test_pivots_eliminate(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 500)
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(20, 8))
    m = centers[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 0.02
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    found = topk.search(df).collect()
    assert sum(r.evaluated for r in found) < 0.4 * 40 * 4000
    v = np.floor(1024 * m)
    for q in range(0, 4000, 100):
        want = sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:10]
        assert sorted({(-r.score, r.vec_id) for r in found if r.query_id == q})[:10] == want


def test_near_duplicates_are_found_and_others_left_alone(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows = text(60), []
    for g in range(12):
        base = text(rng.randint(120, 400))
        rows.append((100 * g, " ".join(base)))
        for k in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((100 * g + k + 1, " ".join(copy)))
    rows += [(5000 + k, " ".join(text(80) + passage + text(80))) for k in range(60)]
    rows += [(7000, "one two"), (7001, "one two"), (7002, None), (7003, ""), (7004, " "), (None, rows[0][1]), (7005, " ".join(text(20000)))]
    rows.append(rows[3])  # a repeated row
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int")
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(df).collect()}
    own = [{"doc_id": r[0], "text": r[1]} for r in rows]
    want = {r["doc_id"]: c for r, c in zip(own, brute.classes(own), strict=True) if c is not None}
    assert {i: got[i] for i in want} == want
    assert got[7002] == 7002 and got[7003] == 7003 and got[None] == 0
    kept = dedup.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({got[i] for i in got})


def test_mixed_large_buckets_are_compared_in_full(spark, monkeypatch):
    """Pairs of texts just above the threshold, all texts just below it: buckets of hundreds of nodes hold many components."""
    monkeypatch.setattr(dedup, "BLOCK", 64, raising=False)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    common, rows = [word() for _ in range(404)], []
    for g in range(200):
        shared = [word() for _ in range(6)]
        rows += [(2 * g + k, " ".join(common + shared + [word() for _ in range(33)])) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = df.select("doc_id", dedup._hashes(df["text"]).alias("words"))
    weights = dedup.run_weights(words.select("words"))
    runs = {r.doc_id: dedup.shingles(np.array(r.words, np.int64), np.array([len(r.words)]))[1:] for r in words.collect()}
    near = [(a, b) for a in runs for b in runs if a < b and dedup.similarity(runs[a], runs[b], weights) >= 0.8]
    assert near == [(2 * g, 2 * g + 1) for g in range(200)]
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(df).collect()}
    assert got == {i: i - i % 2 for i in range(400)}


def test_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.sort(rng.choice(1 << 47, 600, replace=False).astype(np.uint64))
    b = np.sort(np.concatenate([a[:450], rng.choice(1 << 47, 150).astype(np.uint64)]))
    s = dedup.Sampler()
    weight = lambda ids: 1 + (ids % np.uint64(3)).astype(np.float32) / 4
    draws = [s.draw(np.zeros(len(x), np.int64), x, weight(x))[2][0] for x in (a, b)]
    shared = weight(a[:450]).sum()
    true = shared / (weight(a).sum() + weight(b).sum() - shared)
    assert abs((draws[0] == draws[1]).mean() - true) < 0.2


def _dicts(rows):
    return [{"doc_id": r[0], "text": r[1], "lang": r[2], "source": r[3]} for r in rows]


def test_near_duplicates_of_the_tables_equal_brute_force(spark, sf_dir):
    """Every pair of every text by the operator's own weights: recall and precision are 1 on this table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    want = {r["doc_id"]: r["doc_id"] if c is None else c for r, c in zip(rows, brute.classes(rows), strict=True)}
    assert {r.doc_id: r.class_id for r in dedup.near_duplicates(docs).collect()} == want


def test_languages_equal_brute_force(spark, odd):
    rows = _dicts(odd[0])
    got = sorted(((str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in langid.predict(odd[1]).collect()), key=str)
    want = sorted(((str(r["doc_id"]), lang, round(p, 4)) for r, (lang, p) in zip(rows, brute.languages(rows), strict=True)), key=str)
    assert got == want
    none = _docs(spark, [(1, "words without any label", None, "a")])
    assert [(r.lang_pred, r.score) for r in langid.predict(none).collect()] == [("und", 0.0)] and langid.keep_known(none).count() == 0


def test_stages_of_odd_rows_equal_brute_force(odd):
    rows = _dicts(odd[0])
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    assert ids(quality.keep_good(odd[1])) == Counter(r["doc_id"] for r, k in zip(rows, brute.quality_kept(rows), strict=True) if k)
    assert ids(langid.keep_known(odd[1])) == Counter(r["doc_id"] for r, (lang, p) in zip(rows, brute.languages(rows), strict=True) if lang != "und" and p >= 0.5)
    assert ids(mixing.take(odd[1])) == Counter(r["doc_id"] for r, n in zip(rows, brute.mix_times(rows), strict=True) for _ in range(n))
    one = {c for c in brute.classes(rows) if c is not None} | {None}
    wordless = Counter(r["doc_id"] for r in rows if not brute.words(r["text"]))
    assert ids(dedup.keep_one(odd[1])) == Counter(one) + wordless


def test_pipeline_equals_brute_force(spark, sf_dir, library):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "mix_sources", "bpe_tokens"]
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [r for r, k in zip(rows, brute.quality_kept(rows), strict=True) if k]
    rows = [r for r, (lang, p) in zip(rows, brute.languages(rows), strict=True) if lang != "und" and p >= 0.5]
    rows = [r for r, c in zip(rows, brute.classes(rows), strict=True) if c is None or c == r["doc_id"]]
    rows = [r for r, n in zip(rows, brute.mix_times(rows), strict=True) for _ in range(n)]
    want = Counter()
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want


def test_three_hundred_languages(spark, monkeypatch):
    """More languages than a block holds: all are learned, and the blocks give what one block gives."""
    rng = random.Random(9)
    words = {k: ["".join(chr(0x4E00 + 20 * k + rng.randrange(20)) for _ in range(4)) for _ in range(5)] for k in range(300)}
    rows = [(i, " ".join(rng.choice(words[i % 300]) for _ in range(8)), f"l{i % 300:03}", None) for i in range(1800)]
    docs = _docs(spark, rows)
    many = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.predict(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(many[r[0]][0] == r[2] for r in held) > 0.95 * len(held)
    monkeypatch.setattr(langid, "LANGUAGES", 1000)
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.predict(docs).collect()} == many


def test_a_row_repeated_in_bulk(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(7, text, "en", "a")] * 30_000 + [(8, text + " more", "en", "a"), (9, "other words that no one else has here", "en", "a")]
    got = Counter((r.doc_id, r.class_id) for r in dedup.near_duplicates(_docs(spark, rows)).collect())
    assert got == Counter({(7, 7): 30_000, (8, 7): 1, (9, 9): 1})


def test_long_labels_are_cut_into_words(spark):
    label = "freecasino" * 12
    rows = [(1, f"http://{label}.com/x", ""), (2, "http://a.com/free/casino", ""), (3, "http://b.com/free/casino/" + "z" * 90, ""), (4, f"http://{'z' * 90}.net/", "")]
    got = {r.page_id: r.words for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][:-1] == ["free", "casino"] * 12 and "z" * 90 in got[4]


def test_every_character_is_cut_as_by_the_library():
    from tokenizers import Tokenizer

    v = bpe.Vocabulary(bpe.vocabulary_path())
    library, enc = Tokenizer.from_file(bpe.vocabulary_path()), bpe.Encoder(v)
    library.no_truncation()
    library.no_padding()
    texts = [f"a{chr(c)}b" for c in [*range(0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x20000, 3), *range(0x105C0, 0x105F4), *range(0x10D40, 0x10D90), *range(0x16EA0, 0x16EC0)]]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [i for got in enc.encode(text) for x in got for i in x[0]] == want.ids, ascii(text)


def test_long_merges_equal_short_ones(monkeypatch):
    v, rng = bpe.Vocabulary(bpe.vocabulary_path()), random.Random(12)
    words = ["".join(rng.choice("aeinrst" if k % 2 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(60, 900))) for k in range(40)]
    got = [v.merge(list(w)) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 10_000)
    assert got == [v.merge(list(w)) for w in words]


def test_buckets_of_the_same_texts_give_the_same_links(spark):
    n = 300
    rows = [(g, 0, 0, 0, bytes([k // 256, k % 256]), bytes([k // 256, k % 256]), bytes(120)) for g in range(24) for k in range(n) if (k * 7 + g) % 5]
    random.Random(1).shuffle(rows)
    dealt = spark.createDataFrame(rows, "g long, lo int, hi int, own int, node binary, comp binary, sketch binary")
    links = dedup._ordered(dealt).mapInArrow(dedup._compare(None), "a binary, b binary").distinct().collect()
    assert len(links) < 3 * n  # bound by the few least nodes, not by the 24 buckets
    assert len({bytes(x) for r in links for x in r}) == n
