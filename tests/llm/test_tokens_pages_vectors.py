"""Tokens, packing, pages and vectors."""

import random
import zlib

import numpy as np
import pytest

from tessel.llm import extraction, neighbours, packing, pieces
from tessel.llm.queries import tokenizer_file

ALPHABET = "abcdefghijklmnopqrstuvwxyz   eeetttaaaooo,.!?éñ日語😀\n\t▁0123456789"


@pytest.fixture(scope="module")
def model():
    return tokenizer_file("piece_bpe_32k.model")


def _texts(n, seed=1):
    rng = random.Random(seed)
    fixed = ["", " ", "   ", "  a", "a  ", "▁▁a", "x\ty\n\nz", "\x00", "😀 é́", "a" * 500, " " * 40 + "the", "   the cat   sat    on     mat"]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(n)] + [" " * k + "b" for k in range(1, 40)]


def test_encoding_equals_the_library(model):
    import sentencepiece

    codec, lib = pieces.PieceCodec(model), sentencepiece.SentencePieceProcessor(model_file=model)
    for t in _texts(800):
        ids = codec.encode(t)
        assert ids == lib.encode(t, add_eos=True), t
        assert codec.decode(ids) == lib.decode(ids), t


def test_bytes_that_are_no_text_decode_like_the_library(model):
    import sentencepiece

    codec, lib = pieces.PieceCodec(model), sentencepiece.SentencePieceProcessor(model_file=model)
    for data in (b"\xff", b"\xc3", b"ok\xe2\x82", b"\xf0\x9f\x98\x80\xff"):
        ids = [codec.byte_id[b] for b in data]
        assert codec.decode(ids) == lib.decode(ids)
    assert codec.decode([codec.byte_id[0xFF]] * 20_000) == "�" * 20_000


def test_encoding_of_frames(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "héllo wörld ☃", "z"), (3, "héllo wörld ☃", "z")], "doc_id long, text string, decoded string")
    out = pieces.decode(pieces.encode(df, model), model)
    assert sorted((r["doc_id"], r["decoded"]) for r in out.collect()) == [(1, ""), (2, ""), (3, "héllo wörld ☃"), (3, "héllo wörld ☃")]
    assert pieces.encode(df.limit(0), model).count() == 0
    both = pieces.recode(df, model)
    assert both.columns == ["doc_id", "ids", "decoded"] and pieces.recode(df.limit(0), model).count() == 0
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in both.collect()) == sorted((r["doc_id"], r["ids"], r["decoded"]) for r in out.collect())


def test_chunks_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    whole, chunks = Tokenizer.from_file(path), packing.ChunkIds(path)
    for t in [*_texts(500, 2), "<|endoftext|>", "a<|endoftext|>b", "it's we'll '' 're", "É ÑÑ× ÷ ª º", "a b c", "Σς ΑΣ"]:
        assert np.frombuffer(chunks.of(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 120))]
        counts = {s: sizes.count(s) for s in sizes}
        gaps, bins = [], 0
        for s in sorted(sizes, reverse=True):
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - s)
            else:
                bins += 1
                gaps.append(100 - s)
        placed = {}
        for length, lo, hi, first, each, offset in packing.plan(counts, 100):
            for r in range(lo, hi):
                placed.setdefault(first + (r - lo) // each, []).append((offset + (r - lo) % each * length, length))
        assert sum(map(len, placed.values())) == len(sizes) and len(placed) == bins
        for seq in placed.values():
            at = 0
            for offset, length in sorted(seq):
                assert offset == at
                at += length
            assert at <= 100


def test_packing_is_gapless_and_whole(spark, corpus_df, empty_df):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = packing.pack(packing.pieces(corpus_df, path, capacity=64), 64).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in ((r["doc_id"], r["text"]) for r in corpus_df.collect()):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r["piece"])):
            own = ids[r["start"] : r["start"] + r["length"]]
            assert (r["piece"], r["start"], r["length"]) == (k, 64 * k, len(own)) and r["ids_crc32"] == zlib.crc32(own.tobytes())
        assert sum(r["length"] for r in by_doc[doc]) == len(ids)
    for seq in by_seq.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.pieces(empty_df, path)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=content><h1>Head &amp; {n}</h1><p>First   <b>bo</b>ld {n} text that is long enough.<p>Second<br>para {n} goes on for some time.</p>
<div class="ad-slot">Buy</div><form><label>Mail</label><input></form></div><div class="comments"><p>Reader {n} says no</p></div><script>if (a < b) {{ x = "</p>" }}</script><aside>Side</aside><footer>&copy; Site</footer>"""


def test_pages_without_an_article_element(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i), "t") for i in range(6)]
    rows += [(90, None, None, "t"), (91, "http://h.example/z", "", "t"), (92, "x", "<<p>a < b &amp; &nosuch; c", "t"), (0, rows[0][1], rows[0][2], "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extraction.extract(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    for i in range(6):
        assert by[i] == f"Head & {i}\nFirst bold {i} text that is long enough.\nSecond para {i} goes on for some time."
    assert by[90] == by[91] == "" and by[92] == "<\na < b & &nosuch; c"
    assert extraction.extract(df.limit(0)).count() == 0


def test_short_and_link_rich_slots_of_an_article_stay(spark):
    page = "<html><body><div class=a>Same on all pages</div><div class=b><p>Long {n} " + "text of page {n} " * 40 + "</p></div><div class=c><p>Short {n}</p></div><div class=d><a href=/r>Reference {n} by name</a></div><div class=e><p>End {n}</p></div><div class=f><a href=/m>More {n}</a></div></body></html>"
    rows = [(i, "http://short.example/", page.format(n=i)) for i in range(6)]
    got = {r["page_id"]: r["text"].split("\n") for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i][0].startswith(f"Long {i} text") and got[i][1:] == [f"Short {i}", f"Reference {i} by name", f"End {i}"]


def test_lines_that_a_host_repeats_are_no_article(spark):
    """Notice lines without a telling name, inside the article, on all pages and on most of them."""
    page = "<html><body><article><h1>Title {n}</h1><div><span>Read in three minutes</span></div><p>" + "Words of page {n} run on. " * 5 + "</p>{more}<p>Last of {n}.</p></article></body></html>"
    most = "<div class=x1><i></i>Follow the paper on paper</div>"
    rows = [(i, "http://lines.example/", page.format(n=i, more=most if i % 4 else "")) for i in range(8)] + [(20 + i, "http://same.example/", "<body><article><p>One and</p><p>the same</p></article></body>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in extraction.extract(df).collect()}
    for i in range(8):
        assert got[i] == [f"Title {i}", ("Words of page %d run on. " % i * 5).strip(), f"Last of {i}."]
    assert all(got[20 + i] == ["One and", "the same"] for i in range(6))


def _lines(spark, pages):
    df = spark.createDataFrame([(i, "http://roles.example/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"].split("\n") for r in extraction.extract(df).orderBy("page_id").collect()]


def test_tokens_are_told_apart_by_their_place_in_a_class(spark):
    """One line stands in the template of every page and, with the same path, as often as it likes in the article."""
    pages = [f"<article><h1>Title {n}</h1><p>Staff report</p><h2>Story</h2><p>Words of page {n} that run on for long.</p>{'<p>Staff report</p>' * (n % 3)}<h3>{n}</h3></article>" for n in range(9)]
    for n, got in enumerate(_lines(spark, pages)):
        assert got == [f"Title {n}", f"Words of page {n} that run on for long.", *["Staff report"] * (n % 3), str(n)]


def test_text_without_a_fixed_order_is_no_template(spark):
    """Lines that occur once on every page, but in any order, are of no valid class."""
    orders = [(0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2), (2, 0, 3, 1)]
    names = ["<h2>Alpha</h2>", "<h3>Beta</h3>", "<h4>Gamma</h4>", "<h5>Delta</h5>"]
    pages = [f"<article><h1>Title {n}</h1><div><i>Same line</i></div>{''.join(names[k] for k in orders[n % 4])}<p>Words of page {n} that run on for long, and on and on.</p></article>" for n in range(8)]
    for n, got in enumerate(_lines(spark, pages)):
        assert got == [f"Title {n}", *[names[k][4:-5] for k in orders[n % 4]], f"Words of page {n} that run on for long, and on and on."]


def test_outer_template_occurs_once_a_page(spark):
    """A larger class that occurs twice on every page is nested in it; repeated rows do not cancel out."""
    twice = "<dl><dt><b>Name</b></dt><dd><i>Kind</i><u>Size</u></dd></dl>"
    pages = [f"<body><div><p>{n}</p></div>{twice}{twice}</body>" for n in range(6)] * 2
    df = spark.createDataFrame([(i % 6, "http://twice.example/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    got = extraction.templates(df).first()
    tokens = [extraction.parse(x).tokens for x in pages]
    assert len(got["outer"]) >= 3 and all(t.count(x) == 1 for t in tokens for x in got["outer"])
    template = extraction.Template(got["state"])
    for t in tokens:
        roles = template.roles(t)
        assert [r for r in roles if r in set(template.outer)] == template.outer
    assert [(c[0], c[1], len(c[2])) for c in template.state["classes"]] == [(12, 12, 6), (12, 24, 15)]


def test_classes_that_cross_or_nest_in_several_places_are_not_valid():
    row = {"pages": 0, "reach": 0}
    classes = [[9, 9, list(range(1, 6))], [9, 18, [11, 12, 13]], [8, 8, [21, 22, 23, 24]]]
    read = extraction.Classes([x[2] for x in classes])
    assert read.follow([1, 11, 12, 13, 2, 7, 3, 4, 5])[1:] == ({(0, -1, 0), (1, 0, 0)}, None)
    assert read.follow([1, 2, 3, 21, 4, 22, 23, 24, 5])[2] == (0, 2)
    assert read.unordered([1, 2, 4, 3, 5]) == [(0, 0, 2, False), (0, 1, 2, False), (0, 2, 2, True), (0, 3, 4, True), (0, 4, 4, False)]
    nest = {**row, "kind": extraction.NEST, "a": 1}
    assert extraction.mended(classes, [{**nest, "b": 0}]) == classes
    assert extraction.mended(classes, [{**nest, "b": 0}, {**nest, "b": 1}]) == [classes[0], classes[2]]
    assert extraction.mended(classes, [{**row, "kind": extraction.CROSS, "a": 0, "b": 2}]) == classes[:2]


def test_pages_of_marks_that_never_end_are_read_in_linear_time():
    import time

    began = time.perf_counter()
    for part in ('<a "', "<a ", "<!", '<script "', "<p '"):
        for tail in ("", ">", "<p>tail</p>"):
            extraction.parse("<p>x</p>" + part * 20_001 + tail)
    assert time.perf_counter() - began < 30
    assert [p.text for p in extraction.parse('a <b>c</b> <i "d</i> e < f').pieces] == ["a ", "c", " ", " e ", "<", " f"]


def test_templates_are_the_tokens_with_the_pages_own_vector(spark):
    rows = [(i, "http://h.example/", PAGE.format(n=i)) for i in range(6)]
    outer = extraction.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).first()["outer"]
    tokens = extraction.parse(PAGE.format(n=1)).tokens
    places = [tokens.index(t) for t in outer]
    assert len(outer) > 15 and places == sorted(places)


def test_neighbours_on_clustered_vectors(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(20, 16))
    x = (centre[rng.integers(0, 20, 2000)] + 0.2 * rng.normal(size=(2000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0] * 15 + [float("nan")]), (5003, [1.0] * 3), (5004, [1.0] * 15 + [None]), (None, [1.0] * 16)]
    rows += [(6000 + k, x[7].tolist()) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, measured = neighbours.search(df, df.where("vec_id % 20 = 0"))
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids = np.array([i for i, v in rows if i is not None and (i < 5000 or i >= 6000)])
    d = np.concatenate([x, np.repeat(x[7:8], 30, 0)]).astype(float)
    recall = []
    for q in (i for i in ids.tolist() if i % 20 == 0):
        k = int(np.flatnonzero(ids == q)[0])
        s = d @ d[k]
        s[k] = -np.inf
        best = np.lexsort((ids, -np.round(s, 9)))[:20]
        mine = got[q]
        assert sorted(mine) == list(range(1, 21)) and q not in {v for v, _ in mine.values()}
        order = [mine[r] for r in range(1, 21)]
        assert order == sorted(order, key=lambda p: (-p[1], p[0]))
        assert all(abs(sc - s[int(np.flatnonzero(ids == v)[0])]) < 1e-9 for v, sc in order)
        recall.append(np.isin(ids[best], [v for v, _ in order]).mean())
    assert np.mean(recall) >= 0.9 and measured >= 0.9


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(df, df.where("vec_id % 20 = 0"))[0].collect())
    assert got == [(0, 1, 20, 5.0), (0, 2, 1, 4.0), (20, 1, 0, 5.0), (20, 2, 1, 4.0)]
    assert neighbours.search(df.limit(0), df.limit(0))[0].count() == 0
