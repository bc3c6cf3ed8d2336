"""Fill-in-middle: frames against a plain version, the query against its SQL."""

import hashlib
import random
import re

import pytest
from edge import no_docs, odd_docs, odd_rows
from oracle import compare, duck

from cartlake.llm import fim
from cartlake.llm.queries import OP13_SQL, op13_fill_in_middle
from conftest import SF_SMALL


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()      # noqa: E731
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text), out


ODD = ["abc", "a", "é", "ab1cd  e\n\r\n<P", "<P>", "x<S>y", "a<M", "日本語 text 👍👍 mixed", "<<P <S M>", "a" * 500,
       "1" * 500, "ab é" * 300, "\x00\x01", "P>", "<", "<" * 40, "ÀÉ" * 200, "one\u00a0two"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, fim.FRAME_BYTES])
def test_frames_of_any_size(spark, size):
    rng = random.Random(size)
    rows = [(i, t) for i, t in enumerate(ODD * 3)]
    rows += [(1000 + i, "".join(rng.choice("aBz é<>PSM\n日1") for _ in range(rng.randrange(200)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    done = fim.transform(fim.store(df, frame_bytes=size), frame_bytes=size, output="out")
    got = sorted(tuple(r) for r in done.collect())
    assert got == sorted(plain_version(i, t) for i, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_other_shares(spark):
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(300)], "doc_id long, text string")
    stored = fim.store(df)
    assert {r.form for r in fim.transform(stored, plain_percent=0, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in fim.transform(stored, plain_percent=100).collect()} == {"plain"}
    one, two = (fim.transform(stored, seed=s).select("prefix_chars").collect() for s in (1, 2))
    assert one != two


def test_only_cut_frames_are_opened():
    """A cut opens one frame, wherever it is."""
    compress, decompress = fim.codecs()
    text = ("word " * 50000).encode()
    parts = fim.pieces(text, 1000)
    opened = []
    frames = [compress(p) for p in parts]
    units, points, n, last = [], [], 0, 0
    for k, p in enumerate(parts):
        units.append(n)
        points.append(1000 * k)
        n += int(fim.starts(fim.np.frombuffer(p, fim.np.uint8), last)[0].sum())
        last = p[-1]
    doc = fim.Frames(frames, units, points, n, len(text), lambda f: opened.append(1) or decompress(f))
    assert doc.place(77777)[:2] == (77777 // 2 * 5 // 1000 + (77777 // 2 * 5 % 1000 + 4) // 1000,
                                    (77777 // 2 * 5 + 4) % 1000)
    assert len(opened) == 1


def test_odd_rows(spark):
    done = fim.transform(fim.store(odd_docs(spark)))
    assert done.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [plain_version(r[0], r[1])[:-1] for r in odd_rows()]
    assert sorted(map(str, (tuple(r) for r in done.collect()))) == sorted(map(str, want))
    assert fim.transform(fim.store(no_docs(spark))).count() == 0


def test_query_equals_sql(spark):
    ok, said = compare(spark, op13_fill_in_middle, OP13_SQL, SF_SMALL, duck(SF_SMALL))
    assert ok, said
