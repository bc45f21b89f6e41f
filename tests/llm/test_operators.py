import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairforge.llm import (
    byte_pair,
    fingerprints,
    html_extraction,
    language_id,
    lm_scoring,
    minhash_dedup,
    packing,
    pivot_dedup,
    secret_scans,
    toxicity,
)
from pairforge.llm.queries import QUERIES, TOKENIZERS

BYTE = f"{TOKENIZERS}/byte_bpe_50k.json"
WORD = f"{TOKENIZERS}/word_bpe_49k.json"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id bigint, text string, lang string, score double, node bigint, id string, held_out string"


def made(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


ODD = [None, "", " \n\t", "!!", "one", "  two  words ", "\x1cx\x85y　", made(1, 30_000), made(2, 40), made(2, 40)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those inside."""
    rows = [(i, t, "en" if i % 2 else None, 0.5, 7, "x", "y") for i, t in enumerate(ODD)]
    rows += [(8, ODD[8], "en", None, None, None, None), (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def random_text(draw):
    letters = list("abcdefgh  \n\t'sSthe12,.!éñßÉİΣ漢字  \x1c\x85🙂́") + ["<|endoftext|>", "'ll", " the", "\r\n"]
    return "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 5, 30, 200])))


def test_byte_pair_equals_the_library(spark, odd):
    coder, own, draw = Tokenizer.from_file(BYTE), byte_pair.vocabulary(BYTE), random.Random(3)
    texts = [random_text(draw) for _ in range(1500)] + ["x" * 3000 + "ab" * 300]
    for text, ids in zip(texts, own.encode_many(texts)):
        expected = coder.encode(text, add_special_tokens=False).ids
        assert list(array("I", ids)) == expected
        assert own.decode(ids) == coder.decode(expected, skip_special_tokens=False)
    rows = byte_pair.encode_texts(odd, BYTE).collect()
    assert len(rows) == len(ODD) + 2
    assert all(r.decoded == (ODD[r.doc_id] or "") for r in rows if r.doc_id is not None)
    assert byte_pair.encode_texts(odd.limit(0), BYTE).count() == 0


def brute_spans(text):
    out = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [("assign", m.start(), m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def test_secrets_base_and_layers(spark, odd):
    draw = random.Random(5)
    parts = ["password: hunter22x", "TOKEN='abc'", "AKIA" + "Q7" * 9, "ab12" * 7, "api_key==zz/99.x", " é ", "_", "AKIA", "f", ":", "\n"]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 8)))
        assert [(secret_scans.KINDS[k], a, b) for a, b, k in secret_scans.scan(text)[0]] == brute_spans(text)
    inner = "secret=deepvalue99"
    packed = base64.b64encode(gzip.compress(inner.encode(), mtime=0)).decode()
    for text, kind, covered in [
        (f"é see {packed} end", 0, packed),
        ("x password%3Dhunter2222 y", 0, "password%3Dhunter2222"),
        ("x \\u0074oken=abcdef12 y", 0, "\\u0074oken=abcdef12"),
        ("q " + base64.b64encode(base64.b64encode(b"AKIA" + b"Z9" * 9)).decode(), 1, None),
        ("u " + base64.b64encode(b"password%3Dhunter2222").decode() + " v", 0, None),
    ]:
        base, spans = secret_scans.scan(text)
        covered = covered or text.split()[1]
        assert not base and (text.index(covered), text.index(covered) + len(covered), kind) in spans
    deep = "token%" + "25" * 1500 + "3Dabcdef12"  # more layers than calls can nest
    assert (0, len(deep), 0) in secret_scans.scan(deep)[1]
    assert secret_scans.scan("%zz" * 200_000) == ([], [])
    assert all(not r.spans for r in secret_scans.find_secrets(odd).collect())
    clean = secret_scans.redact(odd.withColumn("text", F.lit("a token=abcdef99 b")))
    assert {r.text for r in clean.collect()} == {"a [secret] b"} and clean.columns == odd.columns


def test_secrets_of_repeated_parts(spark):
    packed = base64.b64encode(b"my secret=deepvalue9").decode().rstrip("=")
    for part in (packed, "token%3Dabcdef12", base64.b64encode(f"see {packed} end".encode()).decode()):
        text = f"é {part} one\n{part} two\n{packed} three"
        places = {m.span() for p in (part, packed) for m in re.finditer(p, text)}
        assert {(a, b) for a, b, _ in secret_scans.scan(text)[1]} == places
        assert secret_scans._masked(text, "*") == "é * one\n* two\n* three"


def test_secrets_across_windows():
    coded = lambda t: base64.b64encode(t.encode()).decode()
    long = coded("é ok " * 40 + "password: hunter2222 " + "more " * 30)
    packed = base64.b64encode(zlib.compress(("filler %d " * 40 % tuple(range(40)) + "secret=deepvalue99").encode())).decode()
    wrapped = ["\n".join(t[i : i + 60] for i in range(0, len(t), 60)) for t in (long, packed)]
    for part, before, after in [
        ("\\u0022password\\u0022: \\u0022hunter2222", "{", "\\u0022}"),
        ("password%3A hunter2222", "", " x"),
        (coded("token=abcdef123456"), "data/", "/x"),
        (coded("token=abcdef123456"), "my-", "_end"),
        (wrapped[0], "see\n", "\nThe end"),
        (wrapped[1].replace("\n", "\r\n  "), "x ", " y"),
        (coded("\ufeffmy\u00a0secret=deepvalue99"), "", ""),
        (coded("x secret=deepvalue99"), "", ""),
    ]:
        got = secret_scans.scan(f"{before}{part}{after}")[1]
        assert [(a, k) for a, _, k in got] == [(len(before) + part.startswith("\\") * 6, 0)], part
        assert got[0][1] - len(before) - len(part) in ((0, 2) if after.startswith("/") else (0, 4) if after.startswith("_") else (0,)), part
    assert secret_scans.scan(("ab/cd-ef_" * 50_000) + "\n" + ("word\n" * 50_000)) == ([], [])


def test_language_profiles(spark, odd):
    docs = spark.createDataFrame(
        [(i, made(i, 60) if i % 2 else "zwölf boxkämpfer jagen den großen sylter deich " * 3, "xx" if i % 2 else "de") for i in range(40)],
        "doc_id bigint, text string, lang string",
    )
    rows = language_id.learn_profiles(docs)
    counts = collections.Counter(language_id.grams(" ".join(r.text for r in docs.where("lang = 'de'").collect())).tolist())
    best = sorted(counts, key=lambda g: (-counts[g], g))[: language_id.SIZE]
    assert [r[1] for r in sorted((r for r in rows if r[0] == "de"), key=lambda r: r[2])] == best
    got = by_id(language_id.identify(docs, rows))
    assert all(got[i].lang_pred == ("xx" if i % 2 else "de") and 0 <= got[i].score <= 1 for i in range(40))
    strange = by_id(language_id.identify(odd, rows))
    assert all(strange[i].lang_pred == "und" and strange[i].score == 0 for i in range(4)) and strange[9].lang_pred == "xx"
    assert {r.lang_pred for r in language_id.identify(odd, []).collect()} == {"und"}


def test_toxicity_learns_words(spark, odd):
    draw = random.Random(9)
    rows = [(i, made(i, 30) + (" " + draw.choice(["grumbolt", "grumbolten", "nastix"]) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(docs, docs.where("doc_id % 5 <> 0").select("doc_id", "toxic"))
    got = by_id(toxicity.score(docs, model))
    assert sum(got[i].predicted == y for i, _, y in rows) >= 398
    strange = toxicity.score(odd, model).collect()
    assert len(strange) == len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == 0 for r in strange)
    none = toxicity.fit(docs, docs.where("false").select("doc_id", "toxic"))
    assert {r.predicted for r in toxicity.score(docs.limit(3), none).collect()} <= {0, 1}


def test_toxicity_learns_words_of_few_rows(spark):
    draw = random.Random(10)
    bad = lambda i: "grumbolt" if i >= 40 else "nastix"  # noqa: E731  the latter in 2 % of the toxic rows
    rows = [(i, made(i, 30) + (f" {bad(i)}" if i % 2 == 0 else ""), int(i % 2 == 0)) for i in range(2000)]
    copied = made(5000, 20) + " unheard oddity"
    rows += [(2000 + i, copied, 1) for i in range(1000)]
    rows += [(4000 + i, made(draw.randrange(10**6), 30) + (" nastix" if i < 10 else " oddity" if i < 20 else ""), int(i < 10)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(docs, docs.where("doc_id < 4000").select("doc_id", "toxic"))
    got = by_id(toxicity.score(docs, model))
    assert "nastix" in model["terms"] and not {"oddity", "unheard"} & set(model["terms"])
    assert all(got[4000 + i].predicted == int(i < 10) for i in range(20))


def brute_components(texts):
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, odd):
    draw, texts = random.Random(11), {}
    for i in range(160):
        if i % 4 == 0 or not texts:
            texts[i] = made(100 + i, draw.choice([3, 20, 60, 200]))
        else:
            words = texts[draw.randrange(max(0, i - 12), i)].split()
            for _ in range(draw.choice([0, 1, 1, 2])):
                words[draw.randrange(len(words))] = draw.choice(WORDS)
            texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got, (label, size) = by_id(minhash_dedup.near_duplicates(docs)), brute_components(texts)
    assert {i: r.component_id for i, r in got.items()} == label
    assert {i: r.n_shingles for i, r in got.items()} == size and all(r.kept == (i == r.component_id) for i, r in got.items())
    rows = minhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) + 2 and all(r.component_id == (8 if r.doc_id == 9 else r.doc_id) for r in rows)
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_of_crowded_lists(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL", 4)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    draw, texts = random.Random(12), {}
    for i in range(120):
        words = made(i % 2, 90).split()
        for _ in range(draw.choice([1, 2, 2, 3])):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        texts[i] = " ".join(words)
    label, _ = brute_components(texts)
    assert len(set(label.values())) > 2
    got = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")))
    assert {i: r.component_id for i, r in got.items()} == label


def test_packing_holds_every_id_once(spark, odd):
    coder, own, draw = Tokenizer.from_file(WORD), packing.encoder(WORD), random.Random(4)
    latin = "aeinrtßÀÖØöøÿéñÇÞ×÷µªº" + "!#$%&()*+-./:;<=>?@[]^_`{|}~'" + "\u0301İΣ"
    texts = [random_text(draw) for _ in range(1500)]
    texts += [" ".join("".join(draw.choice(latin) for _ in range(draw.randint(1, 9))) for _ in range(40)) for _ in range(200)]
    texts += [" ".join("".join(draw.choice("aeinrtéÖß") for _ in range(9)) + draw.choice(["", "!?", "***", "'s", "<|"]) for _ in range(40)) for _ in range(100)]
    for text, ids in zip(texts, own.encode_many(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == coder.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(i, made(i, draw.choice([0, 5, 300, 900, 5000]))) for i in range(300)], "doc_id bigint, text string")
    rows = packing.pack(docs, WORD).collect()
    pieces, lines = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        lines[r.sequence_id].append(r)
    for d in docs.collect():
        ids, at = np.array([*coder.encode(d.text, add_special_tokens=False).ids, 2], dtype="<u4"), 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    for line in lines.values():
        at = 0
        for r in sorted(line, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert 4096 * len(lines) <= 1.05 * total + 4096
    strange = packing.pack(odd, WORD).collect()
    assert {r.doc_id for r in strange} == {*range(len(ODD)), None} and packing.pack(odd.limit(0), WORD).count() == 0


def test_plan_fills_windows_within_the_histogram():
    histogram = np.zeros(65, dtype=np.int64)
    histogram[[3, 10, 20, 24, 32, 40, 44, 64]] = [50, 7, 31, 12, 9, 20, 15, 4]
    rows, counts = packing.fitted(histogram, 64)
    used = np.zeros(65, dtype=np.int64)
    for (a, times, b), n in zip(rows, counts):
        assert a * times + b == 64
        used[a] += times * n
        used[b] += n if b else 0
    assert (used <= histogram).all() and used.sum() > 60


def test_fingerprints_next_and_radius(spark, odd):
    docs = spark.createDataFrame([(i * 3, made(i // 2, 50) + ("" if i % 2 else " tail")) for i in range(60)], "doc_id bigint, text string")
    got, rows = by_id(fingerprints.compared_with_next(docs)), docs.orderBy(F.desc("doc_id")).collect()
    for k, r in enumerate(rows):
        following = rows[(k + 1) % len(rows)].text
        half = len(r.text) // 2
        changed = r.text[: len(r.text) - half] + following[:half]
        own, new, other = (fingerprints.fingerprint(t) for t in (r.text, changed, following))
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[r.doc_id].fingerprint == own.hex() and got[r.doc_id].near_edited == fingerprints.likeness(own, new)
        assert got[r.doc_id].near_next == fingerprints.likeness(own, other) and got[r.doc_id].n_chars == len(r.text)
    assert fingerprints.compared_with_next(odd).count() == len(ODD) + 2
    assert fingerprints.compared_with_next(odd.limit(0)).count() == 0
    assert fingerprints.compared_with_next(odd.where("doc_id = 4")).collect()[0].near_next == 1.0
    draw = random.Random(2)
    prints = [draw.getrandbits(256) for _ in range(20)]
    prints += [p ^ sum(1 << b for b in draw.sample(range(256), draw.randint(0, 9))) for p in prints for _ in range(4)]
    table = spark.createDataFrame([(i, bytearray(p.to_bytes(32))) for i, p in enumerate(prints)], "doc_id bigint, fingerprint binary")
    pairs = {(bytes(r.a), bytes(r.b)): r.distance for r in fingerprints.within_radius(table, 7).collect()}
    known = {p.to_bytes(32) for p in prints}
    apart = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    assert pairs == {(a, b): apart(a, b) for a in known for b in known if a < b and apart(a, b) <= 7}


def test_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(6)
    base = draw.normal(size=(60, 32))
    rows = [base[i % 60] + draw.normal(size=32) * (0.12 + 0.02 * (i % 5)) for i in range(600)] + [base[0]] * 5
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0, None], [float("inf"), 1.0], [1.0, 2.0], [2.0, 4.0]]
    table = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(1000 + i, v) for i, v in enumerate(odd)]
    got = {r.vec_id: r for r in pivot_dedup.link_vectors(spark.createDataFrame(table, "vec_id bigint, embedding array<double>").withColumn("unit", F.lit(1))).collect()}
    units = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = units @ units.T >= 0.9
    np.fill_diagonal(linked, False)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert 0.9 * linked.sum() <= found <= linked.sum()
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(6)) and got[1006].n_links == 1
    assert got[1007].component_id == 1006 and not got[1007].kept and got[600].component_id == min(np.flatnonzero(linked[600]))


def test_vectors_of_a_crowd_equal_brute_force(spark, tmp_path):
    draw, n = np.random.default_rng(7), 50_000
    rows = draw.normal(size=(n, 64))
    rows[: n // 3] = rows[0] + draw.normal(size=(n // 3, 64)) * draw.choice([0.1, 0.2, 0.3], size=(n // 3, 1))
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = np.concatenate([(units[i : i + 2000] @ units.T >= 0.9).sum(axis=1) - 1 for i in range(0, n, 2000)])
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(rows)}).to_parquet(tmp_path / "rows.parquet")
    got = pivot_dedup.link_vectors(spark.read.parquet(str(tmp_path / "rows.parquet"))).orderBy("vec_id").toPandas()
    assert np.abs(got["n_links"].to_numpy() - linked).sum() <= 1e-6 * linked.sum()  # products round in another order
    assert (got["component_id"][: n // 3][linked[: n // 3] > 0] == 0).all()


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header class=top>Site</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Big &amp; small</h1><p>First
 <b>bold</b> text<p>Second &eacute;<br>line<ul><li>one<li>two</ul><form>sign up</form><div class="comments"><p>nice!</div></article>
<aside>see also</aside><footer>&copy; me</footer></body>"""


def test_page_text(spark):
    open_ = "<body><div>{0} words stand only here in page {0} and nowhere else at all</div><div>all rights kept by the owners of this small site today</div>"
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "http://a.example/y", "")]
    rows += [(10 + i, "http://b.example/", open_.format(f"n{i} m{i} k{i} j{i} h{i}")) for i in range(3)]
    schema = "page_id bigint, url string, html string"
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, schema).withColumn("row", F.lit(1))).collect()}
    assert got[1] == "Big & small\nFirst bold text\nSecond é line\none\ntwo"
    assert got[2] == "" and got[3] == "" and len(got) == 6
    assert got[11] == "n1 m1 k1 j1 h1 words stand only here in page n1 m1 k1 j1 h1 and nowhere else at all"
    assert html_extraction.extract(spark.createDataFrame([], schema)).count() == 0


def test_repeated_ranks_equal_brute_force():
    draw = random.Random(8)
    streams = [[draw.randrange(3) for _ in range(draw.randint(0, 40))] for _ in range(12)]
    ranks = html_extraction.repeated(streams, 5)
    found = [(tuple(s[i : i + 5]), int(r[i])) for s, r in zip(streams, ranks) for i in range(len(s)) if i + 5 <= len(s)]
    assert len({w for w, _ in found}) == len({r for _, r in found}) == len(set(found))
    assert all((r[max(0, len(s) - 4) :] == -1).all() for s, r in zip(streams, ranks))


def test_language_model(spark, odd):
    texts = {i: made(i, 80) for i in range(300)} | {1000: None, 1001: "", 1002: "unseen zzz"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("training", F.col("doc_id") % 10 != 0)
    got = by_id(lm_scoring.score_texts(docs))
    token = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in texts.items()}
    counts = collections.Counter(w for i, t in token.items() if i % 10 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for i, words in token.items():
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert got[i].base_score == pytest.approx(base) and got[i].n_known == sum(w in counts for w in words)
        assert got[i].n_tokens == len(words) and got[i].train_tokens == total and got[i].score < 0
    assert got[10].score / got[10].n_tokens > -1.6 and got[10].bits_per_byte < 1.2
    strange = lm_scoring.score_texts(odd.withColumn("training", F.lit(False))).collect()
    assert len(strange) == len(ODD) + 2 and all(r.train_tokens == 0 and r.n_known == 0 for r in strange)


def test_all_thirteen_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("inside, kept", [
    ('title="hidden gems"', True), ('data-hidden="0"', True), ('title="class=ad"', True), ('data-role="menu"', True),
    ("hidden=until-found", True), ('style="color:red"', True), ("hidden", False), ("HIDDEN=''", False), ("aria-hidden = true", False),
    ('style="Display : none"', False), ('class="ad"', False), ("id=sidebar", False),
])
def test_attributes_that_hide(inside, kept):
    assert html_extraction.blocks(f"<article><p>one</p><div {inside}>two</div></article>")[1] == ("two", 1 if kept else -1)
