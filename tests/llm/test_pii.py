import hashlib
import random
import re

from vidra.llm.pii import find

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [[m for m in EMAIL.finditer(text)], [m for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]]
    out.append([m for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))])
    out.append([m for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15])
    spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in zip(("email", "ip", "card", "phone"), out) for m in ms)
    return tuple(map(len, out)), spans, hashlib.sha256(spans.encode()).hexdigest()


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in find(docs).collect():
        counts, spans, digest = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == counts, (texts[r.doc_id], r, spans)
        assert r.base_sha256 == digest, (texts[r.doc_id], r.spans, spans)
        assert ",".join(s for s in r.spans.split(",") if s.partition(":")[0] not in ("iban", "ssn")) == spans


def test_random_texts_against_plain_patterns(spark):
    rng = random.Random(3)
    bits = ["a", "Z9", "@", ".", "b.c", "-", "+", " ", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "255", "256", ".7", "(", ")", "+1 (743) 555-3824", "é", "😀", "x@y.zz", "_", "%", "\n", "0", "12", "9"]
    check(spark, ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(1500)])


def test_edges(spark):
    check(spark, [None, "", "@", "1", "+", "a" * 50_000, "1 " * 30_000, "+1" * 20_000, "+" + "1(" * 20_000, "x@" * 20_000, "😀" * 100 + "a@b.cd", "1.1.1.1 " * 3000, "a@b.c " * 3000, "0000255.1.1.1 00256.1.1.1", "4111-1111-1111-1111 " * 2])


def test_added_kinds_need_their_checksum_or_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 here", "IBAN DE88 3704 0044 0532 0130 00 here", "his SSN is 219-09-9999.", "number 219-09-9999.", "xDE89370400440532013000", "GB82WEST12345698765432"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in find(docs).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "ssn:11:22", 3: "", 4: "", 5: "iban:0:22"}


def test_context_raises_the_score_and_empty_tables_work(spark):
    docs = spark.createDataFrame([(1, "from 10.0.0.1 on"), (2, "server 10.0.0.1 on")], "doc_id long, text string")
    low, high = [r.score for r in find(docs).orderBy("doc_id").collect()]
    assert low < high
    assert find(docs.limit(0)).count() == 0
