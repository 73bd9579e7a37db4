import hashlib
import re

import pytest
from pyspark.sql import functions as F
from verdigris.llm import pii

CASES = [
    "", None, "a@b.c", "x a.b+c@d-e.f.g_h@i.j, @k.l m@n", "a@b.c_d@e.f", "a@@b.c a@b..c a@b.", "1.2.3.4.5.6.7.8 999.1.1.1.2.3.4.5 01.002.0003.4", "255.255.255.255 256.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 5 4111111111111111", "12345678901234567890123 4 5", "+1 (017) 555-7713, +1(2)3 +49 30 1234567890 +12 345", "+1234567890123456 ++49 170 1234567.", "é漢😀 a@b.co +1 (767) 555-5699 10.0.0.1",
    "a" * 30000, "1" * 30000, "1 " * 9000, "+1" + " " * 5000, "call (555) 123-4567 now", "bob (at) mail (dot) com", "bob at noon. dot", "a@b.c " * 300,
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 % 10 + (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) if len(t) < 20000 else ():
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if len(t) < 20000 else ():
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def checked(df, texts):
    got = {r.doc_id: r for r in df.select("doc_id", F.expr("transform(base, x -> struct(x.s, x.k, x.e))").alias("b"), F.expr("transform(spans, x -> struct(x.s, x.k, x.e))").alias("a")).collect()}
    for k, t in texts.items():
        assert [tuple(x) for x in got[k].b] == brute(t), t
        a = [tuple(x) for x in got[k].a]
        assert set(brute(t)) <= set(a) and a == sorted(a)
    return got


def test_cases(spark):
    texts = dict(enumerate(CASES))
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, spans int")
    got = checked(pii.spans(docs), texts)
    added = {k: [x for x in got[k].a if x not in got[k].b] for k in texts}
    at = CASES.index("call (555) 123-4567 now")
    assert added[at] and added[at + 1] and not added[at + 2]
    assert not any(added[k] for k in range(at) if k != at)
    assert pii.spans(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = checked(pii.spans(docs), texts)
    assert sum(len(r.b) for r in got.values()) > 50


def test_redacted(spark):
    docs = spark.createDataFrame([(1, "é a@b.co, +1 (767) 555-5699!"), (2, None), (3, "clean")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redacted(docs).collect()} == {1: "é [EMAIL], [PHONE]!", 2: None, 3: "clean"}


def test_digest(spark, tmp_path):
    spark.createDataFrame([(1, "x a@b.co")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = pii.op2_pii(spark, str(tmp_path)).first()
    assert (r.n_email, r.n_ip, r.spans) == (1, 0, "email:2:8") and r.base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()


@pytest.mark.parametrize("pattern", pii.BASE.values())
def test_patterns_compile(pattern):
    re.compile(pattern.replace("++", "+").replace("}+", "}").replace(r"|\G", ""))


#: Prose that is not written from the training templates: spans to be added are between « and ».
ADDED = [
    "If you want the slides, drop a note to «marta at brightfield dot org» before Friday.", "Questions? «jane at mailhost dot com» answers them.", "You can write to «jane12 at mailhost dot com» as well.",
    "Please contact «p.olsen [at] norsk-data [dot] net» for access.", "reach me: «lee.wong (at) example (dot) edu», thanks", "the curator (see «bob42 @ example.com») was away", "send it to «sales @ widgets.io» today",
    "Kontakt: «info(at)stadtwerke.de» oder vor Ort", "mail «k_ito {at} sakura {dot} org» about the grant", "his address is «tom at tomsgarage dot net», he said",
    "Our desk is at «(212) 555-0147» on weekdays.", "For bookings call «555-867-5309» after noon.", "phone: «0171 2345678»", "ring «(030) 901820-44» and ask for Ms Abel", "fax «212-555-0199» or come by", "mobile «0664 1234567» (evenings)",
    "She read her card, «4111.1111.1111.1111», aloud.", "paid with visa «4012/8888/8888/1881» at the till", "credit card number «5555  5555  5555  4444» was declined",
    "The router answered from «fe80::1» within a second.", "Packets to «2001:db8::8a2e:370:7334» were lost.", "ping «2001:db8:85a3:8d3:1319:8a2e:370:7348» works", "her server «fd12:3456:789a:1::1» is down", "the host «2001:0db8:0000:0042:0000:8a2e:0370:7334» moved", "routes via «fe80::204:61ff:fe9d:f156» only",
]
CLEAN = [
    "We met at noon. Dot was late, as always.", "He stayed at home dot dot dot and slept.", "The train leaves at 10.45 sharp.", "Look at figure 3. The line is flat.", "She works at Acme. It pays well.", "They arrived at the hotel. Nobody was there.", "Priced 5 @ 12.50 each, 3 @ 9.99 the rest.",
    "The order 20240117 shipped.", "isbn 9783161484100 is out of print", "on 2024-01-17 14:05 the log ends", "invoice no 884213557 is open", "total 12.345.678 units sold", "the total was 1 234 567 890 before tax", "ref 2023/04/117 applies", "version 10.2.331 of the tool",
    "order 4111.1111.1111.1112 could not be found", "the number 1234567890123456 means nothing", "serial 5500 0000 0000 0005 1 on the lid", "the clock showed 12:30:45 when it stopped", "mix them 3:4:5 by weight", "mac 00:1a:2b:3c:4d:5e was seen", "see std::vector and ns::value for that", "a :: b in that language", "time 09:12:44:17 of the tape", "Psalm 119:105 and 23:1 were read", "from 8:00 to 9:30 and 10:00", "bob at the dot com boom lost it all",
]


def test_added_spans_in_prose(spark):
    """Recall of at least 0.9 at a precision of 0.98 in texts that the templates don't hold; nothing hangs on other words."""
    texts, want = {}, {}
    for i, t in enumerate(ADDED + CLEAN):
        a, b = t.find("«"), t.find("»")
        texts[i] = t.replace("«", "").replace("»", "")
        want[i] = {(a, b - 1)} if a >= 0 else set()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pii.spans(docs).select("doc_id", F.expr("transform(spans, x -> struct(x.s, x.e))").alias("a"), F.expr("transform(base, x -> struct(x.s, x.e))").alias("b")).collect()
    got = {r.doc_id: {tuple(x) for x in r.a} - {tuple(x) for x in r.b} for r in rows}
    hit = lambda x, y: x[0] < y[1] and y[0] < x[1]
    found = sum(any(hit(x, y) for y in got[i]) for i in got for x in want[i])
    right = sum(any(hit(x, y) for x in want[i]) for i in got for y in got[i])
    every = sum(map(len, got.values()))
    assert found >= 0.9 * len(ADDED), [texts[i] for i in got if want[i] and not got[i]]
    assert right >= 0.98 * every, [(texts[i], sorted(got[i])) for i in got if got[i] and not any(hit(x, y) for x in want[i] for y in got[i])]
