"""Base spans against Python's re, and the spans that the method adds."""

import hashlib
import random
import re

import pytest

from voxmill.llm.pii import digest, find_personal_data


def luhn(d):
    return sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}
TEXTS = [
    None, "", "no data here", "mail a.b%c@d-e.f.gh, x@y.z@w.v and a@b.cx_y@d.e.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.001 256.0.0.1 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4111111111111111 12 34", "+1 (555) 123-4567 +12 +1-2 ++49 30 1234567 é +1 555 123 4567 890 123 456",
    "ä𝒳 é 10.0.0.1 𝒳 q@r.st 1" + "2" * 40, "a" * 20000 + "@", "1" * 20000 + ".", "call (555) 123-4567 or 555.123.4567; joe (at) mail (dot) com; 4111.1111.1111.1111",
    "00000001.2.3.4 4111  1111", "x@y.z x@y.z 5.6.7.8", "x@y.z x@y.z 5.6.7.8",
]


def brute(text):
    out = []
    for kind, (pattern, check) in RULES.items():
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if check(m[0])]
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "zz") for i, t in enumerate(TEXTS)] + [(100 + i, f"call {i} +1 ({200 + i}) 555-{1000 + i} or 4{i:015d} at 10.{i}.{7 * i}.9 m{i}@ex.com (555) 0{i}", "k") for i in range(120)] + [(None, "x@y.z", "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    return rows, {r["doc_id"]: r for r in digest(find_personal_data(frame)).collect()}


def test_base(found):
    rows, got = found
    for i, text, _ in rows:
        want = brute(text)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (text or "")[:90]
        assert [r[f"n_{k}"] for k in RULES] == [sum(w.startswith(k) for w in want) for k in RULES]
        assert set(want) <= set(filter(None, r["spans"].split(",")))


def test_order_and_overlap(found):
    rows, got = found
    kinds = list(RULES)
    for i, text, _ in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in filter(None, got[i]["spans"].split(",")))]
        assert spans == sorted(spans, key=lambda s: (kinds.index(s[0]), s[1]))
        base = {tuple(w.split(":")) for w in brute(text)}
        added = [s for s in spans if (s[0], str(s[1]), str(s[2])) not in base]
        for k, a, b in added:
            assert 0 <= a < b <= len(text)
            assert not any(int(x) < b and a < int(y) for _, x, y in base)


def test_disguises_that_nothing_was_learned_from(spark):
    """Planted addresses in forms that are left out of learning, among what only looks
    like them."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))

    def card():
        d = "4" + "".join(rng.choices("0123456789", k=14))
        return next(d + x for x in "0123456789" if luhn(d + x))

    mail = lambda: f"{word()}{rng.randrange(99)}@{word()}.{rng.choice(['com', 'org', 'net'])}"
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    ip = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    rows = [(i, f"{prose(9)} {rng.choice([mail, phone, ip, card])()} {prose(5)}. {prose(4)} {rng.choice([mail, phone, ip, card])()}.") for i in range(1500)]
    rows += [(2000 + i, f"{prose(5)} {rng.randrange(10**15, 10**16)} {prose(3)}") for i in range(300)]
    planted, plain = {}, []
    for i in range(400):
        make = (
            lambda: mail().replace("@", " [at] "),
            lambda: "/".join(re.findall("[0-9]+", phone())),
            lambda: ". ".join(re.findall("....", card())),
            lambda: ip().replace(".", "(.)"),
        )[i % 4]
        text, before = make(), prose(rng.randrange(1, 9)) + " "
        planted[3000 + i] = f"{('email', 'phone', 'card', 'ip')[i % 4]}:{len(before)}:{len(before) + len(text)}"
        rows.append((3000 + i, f"{before}{text} {prose(4)}"))
    looks = (lambda: f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)} 1{rng.randrange(9)}:30", lambda: f"{rng.randrange(10, 99)} @ {rng.randrange(9)} . {rng.randrange(10, 99)}",
             lambda: f"order {rng.randrange(10**9, 10**10)}", lambda: f"v{rng.randrange(300, 999)}.{rng.randrange(300, 999)}.1.2", lambda: f"{word()}{rng.randrange(10**8, 10**9)}{word()}")
    for i in range(400):
        plain.append(5000 + i)
        rows.append((5000 + i, f"{prose(6)} {rng.choice(looks)()} {prose(3)}"))
    got = {r["doc_id"]: r["spans"] for r in digest(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).collect()}
    for kind in RULES:
        own = [i for i, s in planted.items() if s.startswith(kind)]
        assert sum(got[i] == planted[i] for i in own) > 0.9 * len(own), kind
    assert sum(bool(got[i]) for i in plain) <= 4
    assert not any(got[2000 + i] and not brute(dict(rows)[2000 + i]) for i in range(300))


def _digits(rng, n):
    return "".join(rng.choices("0123456789", k=n))


def _card(rng):
    d = "4" + _digits(rng, 14)
    return next(d + x for x in "0123456789" if luhn(d + x))


def _everyday(rng):
    """Kinds and everyday forms."""
    u, h, c = rng.choice(["joe", "ann.lee", "k_smith", "info", "sales7"]), rng.choice(["mail", "acme", "site", "north-wind"]), rng.choice(["com", "org", "net"])
    ip = [str(rng.randrange(256)) for _ in range(4)]
    fours = re.findall("....", _card(rng))
    a, b, d = str(rng.randrange(201, 990)), str(rng.randrange(200, 999)), _digits(rng, 4)
    return {
        "at dot caps": ("email", f"{u} AT {h} DOT {c}"), "at dot": ("email", f"{u} at {h} dot {c}"), "bracket dot": ("email", f"{u}@{h}[.]{c}"), "(at)": ("email", f"{u}(at){h}.{c}"),
        "card _": ("card", "_".join(fours)), "card -": ("card", " - ".join(fours)), "card .": ("card", ".".join(fours)),
        "area": ("phone", f"({a}) {b}-{d}"), "trunk": ("phone", f"020 {_digits(rng, 4)} {d}"), "one": ("phone", f"1-{a}-{b}-{d}"),
        "ip dot": ("ip", " dot ".join(ip)), "ip (dot)": ("ip", "(dot)".join(ip)), "ip ,": ("ip", ",".join(ip)), "ip [.]": ("ip", "[.]".join(ip)),
    }


@pytest.mark.parametrize("data", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_everyday_forms_among_real_documents(spark, data):
    """25 texts of each of 14 forms among all documents of a table, and texts that look alike."""
    rng = random.Random(8)
    words = "the report says that our team will meet again when all of the work has been done and sent".split()
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows, wanted, plain = [], {}, []
    for i in range(25):
        for name, (kind, text) in _everyday(rng).items():
            n = 10_000_000 + len(rows)
            before = f"{prose(rng.randrange(2, 9))} {rng.choice(['contact', 'reach', 'see', 'use', 'call', 'write'])} "
            rows.append((n, f"{before}{text} {prose(4)}"))
            wanted[n] = (name, kind, len(before), len(before) + len(text))
    looks = [
        lambda: f"20{_digits(rng, 2)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", lambda: f"{rng.randrange(10, 99)} @ {rng.randrange(1, 9)}.{_digits(rng, 2)}", lambda: f"order {_digits(rng, 10)}", lambda: f"{rng.randrange(1, 9)}, {rng.randrange(10, 20)}, {rng.randrange(20, 30)}, {rng.randrange(30, 40)}",
        lambda: f"{rng.randrange(1, 99)} {rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(100, 999)}", lambda: f"look at {prose(1)}.{prose(1)}", lambda: f"at home. {prose(2)}", lambda: f"v{rng.randrange(256, 999)}.{rng.randrange(300, 999)}.1.2", lambda: "19" + _digits(rng, 2) + " - 20" + _digits(rng, 2),
    ]
    for i in range(300):
        plain.append(20_000_000 + i)
        rows.append((plain[-1], f"{prose(6)} {looks[i % len(looks)]()} {prose(4)}"))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"].split(",") for r in digest(find_personal_data(docs)).where("doc_id >= 10000000").collect()}
    hits = {}
    for n, (name, kind, a, b) in wanted.items():
        spans = [s.split(":") for s in got[n] if s]
        hits.setdefault(name, []).append(any(k == kind and int(x) < b and a < int(y) for k, x, y in spans))
    found = {name: sum(h) for name, h in hits.items()}
    wrong = sum(bool(got[n] != [""]) for n in plain)
    print(found, wrong)
    assert sum(found.values()) >= 0.9 * len(wanted) and min(found.values()) >= 20, found
    assert wrong <= 3, [dict(rows)[n] for n in plain if got[n] != [""]]


def test_of_spans_that_overlap_the_best_stays(spark):
    from voxmill.llm.pii import _apart

    rows = [(1, 7, "phone", 0, 9, 0.7), (1, 7, "card", 5, 20, 0.9), (1, 7, "phone", 15, 30, 0.8), (1, 7, "phone", 30, 40, 0.6), (1, 7, "email", 50, 60, 2.0), (1, 7, "ip", 55, 58, 0.99), (2, 7, "ip", 0, 4, 0.5)]
    kept = _apart(spark.createDataFrame(rows, "doc_id long, copy long, kind string, start int, end int, score double")).collect()
    assert sorted((r["doc_id"], r["start"]) for r in kept) == [(1, 5), (1, 30), (1, 50), (2, 0)]


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert digest(find_personal_data(frame)).count() == 0
