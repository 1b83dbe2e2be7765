"""Operators 11 to 13 against loops and the public library, with odd rows."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedloom.llm import fill_middle, filter_audit, pieces
from feedloom.llm.filter_audit import FILTERS

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fails string, part int"


def docs_of(spark, rows):
    """Documents of (doc_id, text, source), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, "x", 1) for i, t, s in rows], DOCS).repartition(3)


def test_shapley_values_are_the_mean_over_all_orders():
    random.seed(5)
    for n in (1, 2, 3, 5):
        game = [0, *(random.randrange(-50, 50) for _ in range(2**n - 1))]
        mean = [Fraction(0)] * n
        orders = list(permutations(range(n)))
        for order in orders:
            before = 0
            for i in order:
                mean[i] += Fraction(game[before | 1 << i] - game[before], len(orders))
                before |= 1 << i
        assert filter_audit.shapley(game) == mean


def _audit_rows():
    random.seed(11)
    words = ["alpha", "Beta", "GAMMA", "de$lta", "eps|ilon", "zeta", "eta", "x"] + [f"w{i}" for i in range(80)]
    texts = [" ".join(random.choice(words[: random.choice([8, 88])]) for _ in range(random.choice([3, 49, 50, 51, 90]))) for _ in range(60)]
    texts += [None, "", "  \n", "A" * 30, "word " * 40_000, "a\tb\x0bc\x0cd" * 20] + texts[:25] + [texts[3]] * 12
    rows = [(i, t, random.choice(["s1", "s2", None, ""])) for i, t in enumerate(texts)]
    return rows + rows[70:75] + [(None, texts[3], "s1"), (None, texts[3], "s1"), (None, "only here", "s2")]


def test_audit_against_running_every_order(spark):
    rows = _audit_rows()
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 60)] + [(3, 1, 1), (None, 1, 1), (8, None, None), (61, 1, None)]
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)

    def failed(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {f for f, hit in zip(FILTERS, (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i)) if hit}

    docs = [(s or "", failed(i, t or ""), i in good, i in toxic) for i, t, s in rows]
    want = {}
    for part in {d[0] for d in docs}:
        values = Counter()
        for order in permutations(FILTERS):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                own = [d for d in docs if d[0] == part and f in d[1]]
                want[part, "".join(order), step] = [len(left), len(hit), len(own) - len(hit), sum(d[1] == {f} for d in own), sum(d[2] for d in hit), sum(d[3] for d in hit)]
                values[f] += len(hit)
        for (p, order, step), v in want.items():
            if p == part:
                v.append(values[order[step - 1]])
    made = filter_audit.audit(filter_audit.failures(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in made} == want and len(made) == len(want)


def test_audit_of_an_empty_table(spark):
    none = docs_of(spark, [(1, "a", "s")]).where(F.lit(False))
    assert filter_audit.audit(filter_audit.failures(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def _texts():
    random.seed(9)
    letters = "abcXYZ éß漢🎉\n\t<>PSM1--"
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(90))) for _ in range(250)]
    return texts + ["", "<P>", "a<S>b", "x<M>", "<<P", "<P<S<M", "word" * 5_000, "é" * 3_000, "a b " * 900, "<", "<S"]


@pytest.mark.parametrize("block, part", [(4, 8), (16, 64), (512, 1 << 20)])
def test_cuts_are_where_units_end(block, part):
    for text in _texts():
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        blocks = fill_middle.Blocks(text, block, part)
        assert blocks.n == len(units)
        ends = np.cumsum([0, *map(len, units)])
        for k in {0, 1, len(units) // 3, len(units) // 2, len(units) - 1, len(units)}:
            if 0 <= k <= len(units):
                assert blocks.cut(k) == ends[k]


def test_fill_in_middle_against_a_loop(spark):
    rows = [(i, t, "s") for i, t in enumerate(_texts())] + [(None, "no id at all", "s"), (9001, None, "s")]
    rows += [(7, rows[7][1], "s")]
    made = fill_middle.fill_in_middle(docs_of(spark, rows), keep=("doc_id", "fails"))
    got = sorted(map(tuple, made.withColumn("back", fill_middle.restored("output", "form")).drop("fails").collect()), key=repr)
    want = []
    for i, t, _ in rows:
        t = t or ""
        digits = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want.append((i, len(units), "plain", None, None, t, t))
        elif h[3] % 100 < 20:
            want.append((i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    assert got == sorted(want, key=repr)
    assert {x[2] for x in want} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(docs_of(spark, rows).where(F.lit(False))).count() == 0


def _path():
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=_path())


def _piece_texts():
    random.seed(2)
    letters = "abcdeéü ñ  the\n\t▁▁123'ﬁＡé漢字🎉$$%%aaaaaa\0�<s>ㅏ"
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(120))) for _ in range(1500)]
    return texts + ["", " ", "▁", "a" * 3000, " " * 700, "ab" * 900, "</s>", "<0x41>", "x" * 47, "x" * 48, "y" * 49]


def test_pieces_and_spans_are_the_librarys(sf):
    library, own = _library(), pieces.Model(open(_path(), "rb").read())
    texts = _piece_texts() + pd.read_parquet(f"{sf}/documents.parquet").text.tolist()
    for text, (ids, ends) in zip(texts, own.encode(texts, end=True), strict=True):
        assert ids == library.encode(text, add_eos=True)
        assert own.decode(ids) == library.decode(ids)
        assert ends.tolist() == [p.end for p in library.encode(text, return_type="proto").pieces] + [len(text.encode())]


def test_pieces_of_long_texts_do_not_depend_on_parts_and_caches(monkeypatch):
    text = " ".join(_piece_texts()[:400])
    whole = [(i, e.tolist()) for i, e in pieces.Model(open(_path(), "rb").read()).encode([text, "a b", text])]
    monkeypatch.setattr(pieces, "PART", 70)
    monkeypatch.setattr(pieces, "CACHE", 30)
    monkeypatch.setattr(pieces, "RUN", 5)
    assert [(i, e.tolist()) for i, e in pieces.Model(open(_path(), "rb").read()).encode([text, "a b", text])] == whole


def test_any_ids_are_decoded_as_by_the_library():
    library, own = _library(), pieces.Model(open(_path(), "rb").read())
    random.seed(4)
    for _ in range(4000):
        ids = [random.choice([random.randrange(3, 259), random.randrange(32000), 259, 28705, 1, 2, 0, 13, 242, 191, 164]) for _ in range(random.randrange(12))]
        assert own.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_character_maps_as_the_library_reads_them(rule):
    import sentencepiece

    texts = _piece_texts()[:300] + ["Ａﬁ  ㍿ ①½", "  Ａ  ", "é ", "　", "ǅ ǆ"]
    for options in range(8):
        prefix, escape, squeeze = (bool(options >> k & 1) for k in range(3))
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=escape, remove_extra_whitespaces=squeeze)
        own = pieces.Rules(next(dict(pieces.fields(v)) for k, v in pieces.fields(library.serialized_model_proto()) if k == 3))
        for text in texts:
            made, begin = own(text)
            point = {len(text[:i].encode()): i for i in range(len(text) + 1)}
            want, offsets = library.normalize(text, with_offsets=True)
            assert (made, [point[int(x)] for x in begin]) == (want, list(offsets)), repr(text)


def test_pieces_in_a_table(spark):
    library = _library()
    rows = [(i, t, "s") for i, t in enumerate(_piece_texts()[-40:])] + [(None, None, None), (3, "twice", "s"), (3, "twice", "s"), (900, "long words " * 20_000, "s")]
    docs = docs_of(spark, rows)
    made = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["source_bytes"]) for r in pieces.round_trip(docs, _path()).collect()]
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    assert sorted(made, key=repr) == sorted(want, key=repr)
    back = pieces.decode(pieces.encode(docs, _path(), keep=("doc_id", "fails")), _path(), keep=("doc_id", "fails"))
    assert sorted((repr(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((repr(i), library.decode(library.encode(t or ""))) for i, t, _ in rows)
    assert pieces.round_trip(docs.where(F.lit(False)), _path()).count() == 0


def test_models_that_are_not_read_exactly_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(b"")
