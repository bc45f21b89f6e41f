"""Operators 11 to 13 against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.llm import divergence_audit, fill_in_middle, private_data
from pairforge.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, output string, term string, text_ string"


def rows(spark, texts):
    """Documents with clashing columns."""
    return spark.createDataFrame([(*t, 5, "o", "t", "x") for t in texts], SCHEMA)


def infilled(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("window", [1 << 20, 4096 * 2])
def test_fill_in_middle(spark, window, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "_WINDOW", window)
    draw = random.Random(11)
    letters = ["a", "b ", "<", ">", "P", "é", "漢", "🙂", "́", "\0", "<P", "S>", "\n"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 3, 9, 60]))) for _ in range(700)]
    texts += [None, "", "has <M> in it", "<<P>", "x" * 20_000 + "é" * 20_000, "漢" * 9_000, "ab" * 30_000]
    given = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, "no id é", None, None)]
    expected = sorted([(i, *infilled(i, t), t or "") for i, t, _, _ in given], key=str)
    out = fill_in_middle.restore(fill_in_middle.transform(rows(spark, given)))
    assert sorted([tuple(r) for r in out.collect()], key=str) == expected
    assert len({e[2] for e in expected}) == 3
    assert fill_in_middle.restore(fill_in_middle.transform(rows(spark, given[:1]).limit(0))).count() == 0


def test_fill_in_middle_windows(monkeypatch):
    """Buffers longer than a window, with cuts on and beside its edges."""
    draw = random.Random(12)
    monkeypatch.setattr(fill_in_middle, "_WINDOW", 4096)
    for _ in range(60):
        texts = ["".join(draw.choice("ab<é漢") for _ in range(draw.choice([0, 1, 5, 900, 5000]))) for _ in range(6)]
        made = [infilled(draw.randrange(10**6), t) for t in texts]
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        data = np.frombuffer(b"".join(raw), np.uint8)
        forms = np.array([("plain", "psm", "spm").index(m[1]) for m in made])
        marked = np.flatnonzero(forms)
        first, second = offsets[:-1].copy(), offsets[1:].copy()
        first[marked] = fill_in_middle.byte_places(data, offsets, marked, np.array([made[k][2] for k in marked], np.int64))
        ends = np.array([made[k][2] + made[k][3] for k in marked], np.int64)
        second[marked] = fill_in_middle.byte_places(data, offsets, marked, ends)
        out, to = fill_in_middle.scatter(data, offsets, forms, first, second)
        assert [out[a:b].tobytes().decode() for a, b in zip(to, to[1:])] == [m[4] for m in made]
        back, ends = fill_in_middle.gather(out, to, forms)
        assert back.tobytes() == data.tobytes() and (ends == offsets).all()


def test_fill_in_middle_refuses_lost_marks(spark):
    moved = fill_in_middle.transform(rows(spark, [(i, "some text", "en", "s") for i in range(20)]))
    broken = moved.withColumn("output", F.expr("replace(output, '<S>', '')"))
    with pytest.raises(Exception, match="three marks"):
        fill_in_middle.restore(broken).collect()


def test_fill_in_middle_query(spark):
    out = QUERIES["op11_fill_in_middle"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(out) == len(docs)
    for r in out:
        n, form, prefix, middle, text = infilled(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def audited(docs):
    """Part ``pair`` and ``term`` by the definition."""
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))) for _, text, lang, source in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= 30)
        sums = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if held[t] >= 30) for s in {d[1] for d in mine}}
        whole = sum(sums.values(), collections.Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, own in sums.items():
            pairs = [(-sum(abs(share(own, t) - share(c, t)) for t in kept), o) for o, c in sums.items() if o != s]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(sorted(pairs))]
            used = [(share(whole, t) - share(own, t), t.encode()) for t in own if share(own, t) > share(whole, t)]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(used)[:50])]
    return sorted(out)


AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_divergence_audit(spark):
    draw = random.Random(13)
    letters = "abcdeÉéß漢"
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 3))) for _ in range(400)] + ["İx", "ÀB", "Ab", "aB"]
    docs = []
    for k in range(420):
        lang, source = draw.choice(["en", "en", "fr", None]), draw.choice(["a", "a", "b", "", None, "é"])
        text = draw.choice([" ", "-", "1\n", "\x85", "_"]).join(draw.choices(words, k=draw.randint(0, 150)))
        docs.append((k, text, lang, source))
    docs += [(1, docs[1][1], "en", "b"), (900, None, "en", "none"), (901, "", "few", "x"), (902, "too few", "few", "y"), (903, "w " * 40, "one", "only")]
    docs += [(None, "w", "one", "only")] * 31
    out = divergence_audit.audit(rows(spark, docs))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == audited(docs)
    assert ("few", "x", "pair", "y", 0, 1) in got and not [g for g in got if g[0] == "one" and g[2] == "pair"]
    assert max(g[5] for g in got if g[2] == "term") == 50
    assert divergence_audit.audit(rows(spark, docs[:1]).limit(0)).count() == 0


def test_divergence_audit_splits_long_texts(spark):
    text = ("alpha Beta " * 500_000) + "é" * 5_000_000 + " gamma"
    counts = {r.term: (r.n, r.docs) for r in divergence_audit.term_counts(rows(spark, [(1, text, "en", "s")])).collect()}
    assert counts == {"alpha": (500_000, 1), "beta": (500_000, 1), "é" * 5_000_000: (1, 1), "gamma": (1, 1)}


def test_divergence_run_lengths():
    draw = np.random.default_rng(14)
    for _ in range(200):
        size = int(draw.integers(1, 40))
        dense = [draw.choice([0, 0, 1, 1, 2, 7], size) for _ in range(2)]
        columns = []
        for counts in dense:
            starts, values = divergence_audit.run_lengths(np.flatnonzero(counts), counts[counts > 0], size)
            assert (np.repeat(values, np.diff(starts, append=size)) == counts).all()
            columns.append((starts, values))
        assert divergence_audit.distance(*columns, size) == np.abs(dense[0] - dense[1]).sum()
    large = np.array([2**40, 5, 0])
    assert divergence_audit.shares(large, 2**41, 3).tolist() == [1 + 10**9 * (c + 5) // (2**41 + 15) for c in large.tolist()]


def brute_private(text):
    """The base spans by their patterns."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        own = [int(c) for c in m[0] if c in "0123456789"]
        doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(own))]
        if 14 <= len(own) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], private_data.KINDS.index(s[2])))


def named(spans):
    return [(a, b, private_data.KINDS[k]) for a, b, k in spans]


def test_private_data_base_spans():
    draw = random.Random(15)
    parts = list("0123456789") * 3 + list("  --..@@++()aB_%é漢\n:") + ["::", "1.2.3.4", "A@b.c", "+1 ", "4111111111111111", "iban ", "tel "]
    parts += ["４", "²", "٣", "378282246310005", "25.0255.", "[at]", "://"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))
        base, spans = private_data.scan(text)
        assert named(base) == brute_private(text), text
        assert set(base) <= set(spans)
    for text in ("9" * 300_000, "1." * 600_000, "a@" * 300_000, "+1" * 300_000, "1 2-" * 300_000, "a" * 300_000 + "@", "de12 " * 200_000, "::" * 300_000):
        base, spans = private_data.scan(text)
        assert len(spans) == len(base) == (75_000 * 2 if text.startswith("1.") else 0)


def test_private_data_of_cues():
    for before, found, after, kind in [
        ("é write to ", "jo.e [at] mail [dot] example [dot] org", " now", "email"),
        ("é ", "joe%40example.com", "&x", "email"),
        ("漢 ", "joe＠example.com", "!", "email"),
        ("Phone number: ", "(017) 555-7713", " x", "phone"),
        ('<a href="tel:', "0175557713", '">', "phone"),
        ("https://", "joe:secret", "@example.com/", "account"),
        ("http://[", "2001:db8::1", "]/", "ip"),
        ("from ", "fe80::1:2", ", ok", "ip"),
        ("My IBAN is ", "DE89 3704 0044 0532 0130 00", " thanks", "account"),
        ("pay ", "GB82WEST12345698765432", ".", "account"),
        ("SSN: ", "078-05-1120", "", "account"),
        ("passport no. ", "X1234567", ", valid", "account"),
        ("Konto 12345", "", "", None),
        ("call me at ", "555-7713-12", "é", "phone"),
        ("mentell 5557713, hotel 5557713, Tel Aviv, std::vector, 12::30, DE89 3704 0044 0532 0130 01", "", "", None),
        ("accounted 123456789, ssn 000-12-3456, name [at] home, a::b", "", "", None),
    ]:
        base, spans = private_data.scan(before + found + after)
        expected = [(len(before), len(before) + len(found), kind)] if kind else []
        assert named(s for s in spans if s not in base) == expected, before + found
        assert named(base) == brute_private(before + found + after)
    text = "mail joe@example.com or +1 (017) 555-7713, ssn 078-05-1120"
    assert private_data._masked(text) == "mail [email] or [phone], ssn [account]"


def test_private_data_query(spark):
    odd = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "é a@b.cd", "en", "s"), (3, "é a@b.cd", "en", "s"), (None, "1.2.3.4", None, None)]
    got = private_data.find_private_data(rows(spark, odd))
    assert got.columns == ["doc_id", "base", "spans"]
    assert sorted(((r.doc_id, len(r.base), len(r.spans)) for r in got.collect()), key=str) == sorted([(1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1), (None, 1, 1)], key=str)
    assert private_data.find_private_data(rows(spark, odd).limit(0)).count() == 0
    hidden = private_data.mask(rows(spark, odd))
    assert hidden.columns == rows(spark, odd).columns
    assert sorted((r.text for r in hidden.collect()), key=str) == ["", None, "[ip]", "é [email]", "é [email]"]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = QUERIES["op13_private_data"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(docs)
    for r in out:
        spans = brute_private(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in private_data.BASE_KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert not joined or set(joined.split(",")) <= set(r.spans.split(","))


def test_pages_that_markup_decides_are_not_shuffled(spark):
    from pairforge.llm import html_extraction

    rows = [(1, "http://h/1", "<article><p>one two</p></article><nav>menu</nav>"), (2, "http://h/2", "<p>three</p>"), (3, None, None)]
    found = html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert sorted((r.page_id, r.text) for r in found.collect()) == [(1, "one two"), (2, "three"), (3, "")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join LeftOuter") :].splitlines()
    assert plan.lstrip().startswith("Union") and "exists(said" in "".join(joined[:4])
