"""WARC packages, piece codec and page extraction."""

import hashlib
import io
import random
import time
import zipfile

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from wardlight.llm import extraction, pieces, warc
from wardlight.llm.dom import Page, measures

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("large", [False, True])
def test_directory_reads_what_zipfile_writes(large, monkeypatch):
    if large:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    members = {f"m/{k}": random.Random(k).randbytes(50 * k) for k in range(6)}
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
        z.writestr("packed", b"x" * 500, zipfile.ZIP_DEFLATED)
    source = pa.BufferReader(out.getvalue())
    found = {m.name: m for m in warc.directory(source)}
    assert set(found) == {*members, "packed"}
    for name, data in members.items():
        a, b = warc.stored_range(source, found[name])
        assert out.getvalue()[a:b] == data
    with pytest.raises(ValueError, match="not stored"):
        warc.stored_range(source, found["packed"])


def test_packages(spark):
    big = "é" * 700
    rows = [(1, "u1", big), (5, "a b\n", big), (5, "again", big), (3, None, big), (7, "u", None), (8, "u", ""), (9, "u", "x" * 999), (10, "u", "x" * 999),
            (11, "u", "z" * 200_000), (None, "u", "no id"), (2, "u", "line\r\n\r\nline")]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, keeper int, digest string").repartition(2)
    got = warc.read_packages(warc.write_packages(pages)).collect()
    want = []
    for page, _, html in rows:
        if page is not None:
            data = (html or "").encode()
            same = [p for p, _, h in rows if p is not None and (h or "") == (html or "")]
            old = len(data) >= 1000 and page < max(same)
            want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if old else "response", max(same) if old else None, None if old else data))
    plain = lambda x: tuple(map(str, x))
    assert sorted(plain((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got) == sorted(map(plain, want))
    assert {r.url for r in got if r.page_id == 5} <= {"a%20b%0A", "again"}
    assert warc.read_packages(warc.write_packages(pages.where("false"))).collect() == []


def brute_force(tool, scores, text):
    """Best score of any split into pieces, tried at all places."""
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        options = [best[a] + scores[text[a:end]] for a in range(end) if text[a:end] in scores]
        if text[end - 1:end] not in scores:
            options.append(best[end - 1] + tool.unknown)
        best[end] = max(options)
    return best[-1]


def test_viterbi_is_best_and_decodes_back():
    from sentencepiece import SentencePieceProcessor

    tool, model, r = pieces.codec(PIECES), SentencePieceProcessor(model_file=PIECES), random.Random(4)
    scores = {model.id_to_piece(k): model.get_score(k) for k in range(3, model.get_piece_size()) if not model.is_byte(k)}
    texts = ["the", "Hello  wörld \n x", "", " ", "   a", "x \x00 y", "梦é€😀", "a▁b"] + ["".join(r.choice("aben thr é\n梦€😀  ﬁ0.") for _ in range(25)) for _ in range(200)]
    for text in texts:
        ids = np.frombuffer(tool.encode(text), "<u4").tolist()
        if "▁" not in text:
            assert tool.decode(tool.encode(text)) == text
        marked = ("▁" + text.replace(" ", "▁")) if text else ""
        unknown = [c for c in marked if c not in scores]
        mine = sum(scores[p] for p in (model.id_to_piece(k) for k in ids if not model.is_byte(k))) + len(unknown) * tool.unknown
        assert mine == brute_force(tool, scores, marked)
        assert tool.viterbi(marked) == ids  # words on their own are as good as the whole


def test_codec_queries(odd, none):
    encoded = pieces.encode_documents(odd, PIECES)
    back = {(r.doc_id, r.text) for r in pieces.decode_documents(encoded, PIECES).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.collect() if r.doc_id is not None}
    rows = pieces.encode_and_decode(odd, PIECES).collect()
    assert all(r.same for r in rows) and len(rows) == odd.where("doc_id IS NOT NULL").count()
    assert pieces.encode_and_decode(none, PIECES).collect() == []


@pytest.fixture(scope="module")
def models():
    return extraction.fit("the of and to in that was for with his this from".split(), built=250)


def test_held_out_pages(models):
    builder = extraction.Builder("some other words of a page".split(), seed=99)
    exact, score, n = 0, 0.0, 80
    for _ in range(n):
        html = builder.page()
        page = Page(html, extraction.LABEL)
        want = [t for k, t in page.blocks if page.nodes[k].main]
        got = extraction.texts([html.replace(extraction.LABEL, "")], models)[0]
        exact += got == "\n\n".join(want)
        a, b = set(want), set(got.split("\n\n"))
        score += 2 * len(a & b) / (len(a) + len(b))
    assert exact / n > 0.85 and score / n > 0.97


def test_states_do_not_contradict():
    page = Page("<body><div><p>a</p><div><p>b</p></div></div></body>")
    n = len(page.nodes)
    main, wrap = np.full(n, -5.0), np.full(n, -5.0)
    main[-1] = 1.0  # a paragraph alone against parts that are surely left out
    assert extraction.decode(page, main, wrap) == ""
    wrap[:-1] = 5.0
    assert extraction.decode(page, main, wrap) == "b"


def test_given_pages_and_odd_rows(spark, models):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html as h
    import re
    for r, got in zip(rows.collect(), extraction.extract(rows, models).collect(), strict=True):
        part = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        part = re.sub(r"<[^>]*>", "", re.sub(r"<br/?>", " ", re.sub(r"</?(p|h1|h2|li|ul|div)[^>]*>", "\0", part)))
        assert got.text == "\n\n".join(x for x in (" ".join(h.unescape(q).split()) for q in part.split("\0")) if x)
    odd = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (None, "u", "<p", 3), (4, "u", "<" * 3000 + "</p></div>&#0;&bogus;", 4), (4, "u", "<div>" * 3000 + "x", 4)],
                                "page_id long, url string, html string, text int")
    got = extraction.extract(odd, models).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert extraction.extract(odd.where("false"), models).collect() == []
    assert extraction.sample_words(odd.where("false")) == []




@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "<div><p>a" * 50_000, "<b>" * 100_000 + "x" + "</i>" * 1000, "<ul><li>" * 50_000])
def test_deep_pages_take_linear_time(html):
    start = time.process_time()
    measures(Page(html))
    assert time.process_time() - start < 5


def test_word_caches_are_bounded_by_bytes(monkeypatch):
    tool = pieces.Codec(PIECES)
    monkeypatch.setattr(pieces, "CACHE", 20_000)
    long = ["漢字" * 500 + str(k) for k in range(30)]  # no blanks: a word each
    for k, text in enumerate(long + [f"word{j} other{j}" for j in range(500)]):
        assert np.array_equal(np.frombuffer(tool.encode(text), "<u4"), tool.viterbi(pieces.MARK + text.replace(" ", pieces.MARK))), k
        assert tool.cached < 20_000 + pieces.ENTRY + 1000 and max(map(len, tool.cache), default=0) <= pieces.LONGEST
