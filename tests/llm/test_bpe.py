import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm.bpe import LEAF, Coder, default_path, encode, ids, op6_bpe_tree

from .helpers import clashing, docs, hard_rows, prose


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.no_padding()
    t.no_truncation()

    def both(text):
        found = t.encode(text or "", add_special_tokens=False).ids
        return " ".join(map(str, found)), t.decode(found, skip_special_tokens=False), len(found)

    return both


@pytest.fixture(scope="module")
def coder():
    return Coder(default_path(), leaf=64, window=8)


ODD = list("aAbZz019'.,!?-_/<|>&;#@$%*+=()[]^`{}~:\\\" \t\n\r\x0b\x0c\x1c\x85  éÉßİıſḰ日本👍🏽한‍﻿\x00")


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(ODD), max_size=80))
def test_as_the_library_does(text):
    test_as_the_library_does.coder = getattr(test_as_the_library_does, "coder", None) or Coder(default_path(), leaf=16, window=4)
    from tokenizers import Tokenizer

    t = test_as_the_library_does.t = getattr(test_as_the_library_does, "t", None) or Tokenizer.from_file(default_path())
    t.no_padding()
    t.no_truncation()
    want = t.encode(text, add_special_tokens=False).ids
    (got,) = test_as_the_library_does.coder.encode([text])
    assert got == (" ".join(map(str, want)), t.decode(want, skip_special_tokens=False), len(want))


SPECIAL = ["<|endoftext|>", "<|startoftext|>x", "a<|endoftext|>b c<|startoftext|>", "<|ENDOFTEXT|>", "don't I'll we've", "Hello,WORLD!! 3.14", "it's 'S 's", "....!!!", "é É"]


@pytest.mark.parametrize("text", SPECIAL)
def test_special_strings(library, coder, text):
    assert coder.encode([text]) == [library(text)]


@pytest.mark.parametrize("kind", ["letters", "one", "mixed", "signs", "digits", "wide", "period", "marks"])
def test_long_unsplit_text(library, coder, kind):
    r = random.Random(kind)
    n = 5000
    text = {
        "letters": lambda: "".join(r.choice("etaoinshrdlu") for _ in range(n)),
        "one": lambda: "a" * n,
        "mixed": lambda: "".join(r.choice("abcXYZ019.,'-_") for _ in range(n)),
        "signs": lambda: "".join(r.choice("!?.-=*") for _ in range(n)),
        "digits": lambda: "".join(r.choice("0123456789") for _ in range(n)),
        "wide": lambda: "".join(r.choice("日本語中文한국é👍") for _ in range(n // 4)),
        "period": lambda: "thequickbrownfox" * (n // 16),
        "marks": lambda: "".join(r.choice(["a", "é", "İ", "'s", "'ll"]) for _ in range(n // 2)),
    }[kind]()
    assert coder.encode([text]) == [library(text)]
    assert Coder(default_path()).encode([text]) == [library(text)]


@pytest.mark.parametrize("kind", ["letters", "prose", "base64"])
def test_joins_encode_little_again(library, kind):
    r = random.Random(kind)
    n = 65_536
    text = {
        "letters": lambda: "".join(r.choice("etaoinshrdlu") for _ in range(n)),
        "prose": lambda: prose(3, n // 8),
        "base64": lambda: base64.b64encode(r.randbytes(n)).decode(),
    }[kind]()
    coder = Coder(default_path())
    assert coder.encode([text]) == [library(text)]
    assert coder.treed == len(text) and 0 < coder.again < 0.2 * len(text)


def test_windows_that_reach_into_runs_of_words(library, monkeypatch):
    """A run is put back as words where a window at a join grows into it; white space of several kinds, and long words between runs."""
    r = random.Random(11)
    parted = []
    real = Coder._parted
    monkeypatch.setattr(Coder, "_parted", staticmethod(lambda *a: (got := real(*a), parted.append(1) if got is not None else None)[0]))
    coder = Coder(default_path(), leaf=400, window=16)
    for _ in range(60):
        words = [r.choice(["a", "e", "ha", "é"]) * r.choice([12, 24, 31, 80]) if r.random() < 0.15 else "".join(r.choices("abcdeé漢.,'", k=r.randrange(1, 10))) for _ in range(r.randrange(100, 500))]
        text = "".join(w + r.choice([" ", "  ", "\n\t", "\x0b"]) for w in words)
        assert coder.encode([text]) == [library(text)]
    assert parted


def test_long_documents_go_through_the_tree(spark, library):
    """Whole documents beyond a leaf, as the query sends them."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if len(r[0] or "") > LEAF]
    coder = Coder(default_path())
    assert coder.encode(texts) == [library(t) for t in texts] and coder.treed == sum(map(len, texts)) > 50 * LEAF


def test_bounded_table(library):
    small = Coder(default_path(), known=20)
    texts = [prose(i, 30) for i in range(20)]
    for t in texts * 2:
        assert small.encode([t]) == [library(t)]
    assert len(small.words) < 200


def test_hard_rows(spark, library):
    df = clashing(docs(spark), "id n_tokens ids_text decoded")
    got = encode(df, default_path(), leaf=512)
    want = sorted([(str(i), *library(t)) for i, t, *_ in hard_rows()])
    assert sorted((str(r["doc_id"]), r["ids_text"], r["decoded"], r["n_tokens"]) for r in got.collect()) == want
    assert encode(docs(spark, []), default_path()).collect() == []
    arrays = got.select(ids(got["ids_text"]).alias("a"), "n_tokens").collect()
    assert all(len(r["a"]) == r["n_tokens"] for r in arrays)


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        found, shown, n = library(t)
        want.add((i, n, digest(found), digest(shown)))
    assert {tuple(r) for r in op6_bpe_tree(spark, sf).collect()} == want
