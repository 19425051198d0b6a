"""Secret scans and personal data against plain searches."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import pii, secrets
from strata.llm.base import packed, span_digest, texts
from tests.llm.conftest import ODD

KEYWORD = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = re.compile(KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda f: (f[1], secrets.BASE_KINDS.index(f[0])))


def random_text(rng, alphabet, pieces, n):
    return "".join(rng.choice(pieces) if rng.random() < 0.4 else rng.choice(alphabet) for _ in range(rng.randrange(n)))


def test_secrets_equal_plain_search():
    rng = random.Random(1)
    pieces = ["password", "ToKen", "api_key", "APIKEY", "secret", "ſecret", "toKen", " = ", ":", '"', "AKIA", "ABCDEFGH12", "0123456789abcdef", "=", "passwd"]
    for _ in range(4000):
        text = random_text(rng, "aAf0 9_.\n:é", pieces, 40)
        assert [f for f in secrets.find_secrets(text) if f[0] in secrets.BASE_KINDS] == plain_secrets(text), text


def test_ledger_scans_each_blob_and_rule_version_once(spark, tmp_path, docs):
    key = 'token = "abcdefghijkl0123"'
    first = docs([(1, key), (2, key), (3, "nothing"), (4, None), (5, ""), (6, "é" + key)])
    ledger = secrets.BlobLedger(spark, str(tmp_path / "ledger"))
    ledger.scan(first)
    assert ledger.known().count() == 4
    ledger.scan(docs([(7, key), (8, "new " + key)]))
    assert ledger.known().count() == 5  # only the new text
    ledger.scan(first.filter("false"))
    other = secrets.BlobLedger(spark, ledger.path, "other rules")
    other.scan(first)
    assert (ledger.known().count(), other.known().count()) == (5, 4)
    found = {r["doc_id"]: [tuple(f) for f in r["findings"]] for r in ledger.findings(texts(first)).collect()}
    assert found == {1: plain_secrets(key), 2: plain_secrets(key), 3: [], 4: [], 5: [], 6: [("assign", 1, 26)]}


def test_secret_digest_of_odd_rows(spark, tmp_path, docs):
    rows = texts(docs(ODD))
    ledger = secrets.BlobLedger(spark, str(tmp_path / "l"))
    ledger.scan(rows)
    out = ledger.findings(rows).select("doc_id", *span_digest(F.col("findings"), secrets.BASE_KINDS)).collect()
    assert len(out) == len(ODD) and all(r["spans"] == "" and r["n_hex"] == 0 for r in out)
    assert ledger.findings(rows.filter("false")).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_personal_data_equal_plain_search():
    rng = random.Random(2)
    pieces = ["a.b@c.de", "@x.y", "+1 (407) 555-7710", "4111 1111 1111 1111", "10.0.0.1", "256.1.1.1", "5472476151044309", "1.2.3.4.5", "0000000000000000"]
    for _ in range(6000):
        text = random_text(rng, "ab@@..--_+% 0123()\n٣é", pieces, 40)
        assert sorted(pii.base_spans(text)) == sorted(plain_pii(text)), text
    assert pii.base_spans("1" * 200_000 + "@" + "." * 200_000) == []


def test_boosted_trees_learn_and_calibrate():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.5)).astype(float)
    model = pii.fit_trees(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.97
    cut = pii.calibrate(np.zeros(1000, int), model.score(x[3000:]), y[3000:], 0.9)
    taken = model.score(x[3000:]) >= cut["email"]
    assert taken.sum() > 100 and y[3000:][taken].mean() >= 0.9


def test_model_adds_spans_and_keeps_base(spark, docs):
    rng = random.Random(4)
    number = lambda: "+1 (%03d) 555-%04d" % (rng.randrange(1000), rng.randrange(10_000))
    rows = docs([(i, f"call {number()} or write a{i}@b.org, order {rng.randrange(10**8, 10**9)}") for i in range(300)], clash=False)
    model = pii.train(texts(rows), precision=0.9)
    assert model.thresholds
    text = "call +1 (407) 555-7710 now"
    (spans,) = pii.find_pii([text], model)
    assert ("phone", 5, 22) in spans
    assert pii.redact(text, spans) == "call [PHONE] now"
    assert pii.redact("abcdef", [("email", 1, 3), ("ip", 2, 5)]) == "a[EMAIL]f"


@pytest.mark.parametrize("clash", [False, True])
def test_personal_data_of_odd_rows(docs, clash):
    rows = packed(docs(ODD, clash))
    model = pii.train(rows.select("doc_id", "text"))
    assert model.thresholds == {}
    out = pii.with_spans(rows, model).collect()
    assert len(out) == len(ODD) and all(r["spans"] == [] and r["redacted"] == r["text"] for r in out)
    assert pii.with_spans(rows.filter("false"), model).count() == 0


def test_forms_outside_the_base_rules_are_found(spark, docs):
    rng = random.Random(9)
    words = "the parcel went out on monday and came back without any note from them".split()
    prose = lambda: " ".join(rng.sample(words, 8))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [(i, f"{prose()} {rng.choice(['call', 'phone'])} +1 ({rng.randrange(200, 1000)}) 555-{digits(4)} {prose()} write jo.{digits(2)}@mail{i % 9}.example.com {prose()} order {digits(9)} "
             f"version {rng.randrange(9)}.{digits(3)}.{digits(4)} {prose()} token = \"{digits(9)}ab{digits(9)}\"") for i in range(1500)]
    model = pii.train(texts(docs(rows, clash=False)))
    assert {"email", "phone"} <= set(model.thresholds)
    planted = ["ann.31 [at] mail4 [dot] example [dot] com", "bob.77(at)mail2(dot)example(dot)com", "407-555-7710", "(407) 555-7710", "001 407 555 7710"]
    found = pii.find_pii([f"{prose()} {prose()} {p} {prose()}" for p in planted], model)
    assert sum(len(f) == 1 and f[0][2] - f[0][1] == len(p) for f, p in zip(found, planted)) >= 4
    others = [f"order {digits(9)}" for _ in range(50)] + [f"version {rng.randrange(9)}.{digits(3)}.{digits(4)}" for _ in range(50)] + [f"token = \"{digits(9)}ab{digits(9)}\"" for _ in range(50)]
    assert sum(map(bool, pii.find_pii([f"{prose()} {o} {prose()}" for o in others], model))) <= 7


def seconds(fn, *args):
    began = time.process_time()
    fn(*args)
    return time.process_time() - began


def test_long_runs_are_searched_in_linear_time():
    for long in ("eyJ" * 350_000, "eyJabcdefgh." * 90_000, "password" * 130_000, "gho_" * 250_000):
        assert seconds(secrets.find_secrets, long) < 1.5
    token = "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4"
    assert secrets.find_secrets(f"a {token} b") == [("jwt", 2, 2 + len(token))] and secrets.find_secrets(f"xeyJ{token[3:]}") == []
    model = pii.PiiModel(pii.Trees(start=1.0), {k: 0.5 for k in pii.BASE_KINDS})
    numbers = "+1 407 555 7710 555-7711 4111.1111.1111 10.0.0.1 " * 600
    small, large = (min(seconds(pii.find_pii, [numbers * k], model) for _ in range(2)) for k in (1, 6))
    assert large < 14 * small
    for long in ("1 " * 15_000, "1" * 300_000, "a at b dot " * 20_000, "at" * 100_000, "@a." * 60_000):
        assert seconds(pii.candidates, long) < 6


def test_joined_numbers_and_long_addresses_are_candidates():
    text = "555 123 4567 555 123 4568 555 123 4569 555 123 4570 555 123 4571 555 123 4572"
    found = pii.candidates(text)
    assert {("phone", 13 * i, 13 * i + 12) for i in range(6)} <= set(found)
    assert len(found) <= 3 * pii.MOST_DIGITS * len(text.split())
    local, domain = "n" * 200, " dot ".join(["part"] * 9 + ["x" * 30])
    assert ("email", 4, 4 + len(f"{local} at {domain}")) in pii.candidates(f"say {local} at {domain}.")
    assert ("email", 0, 602) in pii.candidates("a@" + "b" * 600)


def test_taken_spans_meet_like_a_plain_search():
    rng = random.Random(6)
    for _ in range(300):
        spans, taken = [], pii.Taken()
        for _ in range(12):
            s = rng.randrange(40)
            e = s + rng.randrange(1, 8)
            hit = any(a < e and s < b for a, b in spans)
            assert taken.meets("k", s, e) == hit and not taken.meets("other", s, e)
            if not hit:
                spans.append((s, e))
                taken.add("k", s, e)
