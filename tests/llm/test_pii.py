import hashlib
import math
import random
import re

from cratewise.llm import pii
from cratewise.llm.pii import digest, find, sanitised

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def corpus():
    rng = random.Random(9)
    bits = ["a@b.c", "x.y%z@mail-1.example.com", "@", "a@b", "b.c@d.e@f.g", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.002.000.0255", "4111 1111 1111 1111", "4111111111111112", "79927398713", "378282246310005",
            "+1 (234) 555-1234", "+1-2", "+12345678901234567", "word", "Éa", "🙂", ".", "-", " ", "  ", "\n", "+", "5", "12", "%"]
    return [(i, "".join(rng.choice(bits) + rng.choice(["", " ", " ", "."]) for _ in range(rng.randrange(1, 14)))) for i in range(600)]


def test_identifiers(documents):
    rows = [*corpus(), (1000, None), (1001, ""), (1002, "a" * 30_000), (1003, "9" * 30_000), (1004, "1 " * 20_000), (1005, "a." * 9_000 + "@" + "b." * 9_000 + "c"), (1006, "x@y.zz " * 3000), (7, "a@b.cd"), (7, "a@b.cd"), (None, "1.2.3.4")]
    got = sorted(map(tuple, digest(find(documents(rows).repartition(3))).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()), key=repr)
    want = []
    for doc_id, text in rows:
        spans = brute(text)
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        counts = [sum(s[2] == k for s in spans) for k in PLAIN]
        want.append((doc_id, *counts, hashlib.sha256(listed.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_terms_that_reveal_an_entity(documents):
    rows = [(i, f"text number w{chr(97 + i % 26)}{chr(97 + i // 26)} about the plain weather") for i in range(300)]
    # "zorblatt" stands beside one address only, "plain" stands everywhere
    rows += [(1000 + i, f"case {chr(97 + i)}xx Zorblatt plain ann@home.org of the day {'pq' * (i + 1)}") for i in range(4)]
    rows += [(2000 + i, "copied quixnote bob@home.org here") for i in range(5)]  # one text: no evidence
    got = {r["doc_id"]: r["spans"] for r in digest(find(documents(rows))).collect()}
    text = dict(rows)[1001]
    spans = [s.split(":") for s in got[1001].split(",")]
    terms = {text[int(a) : int(b)] for kind, a, b in spans if kind == "term"}
    assert "Zorblatt" in terms and "plain" not in terms and not any("@" in t or t in "ann home org" for t in terms)
    assert all("term" not in got[i] and "general" not in got[i] for i in [*range(300), *range(2000, 2005)])
    clean = {r["doc_id"]: r["text"] for r in sanitised(documents([*rows, (1, None)])).collect()}
    assert "Zorblatt" not in clean[1001] and "[REMOVED] plain [EMAIL]" in clean[1001] and clean[5] == dict(rows)[5] and clean[2000] == "copied quixnote [EMAIL] here"


def test_disclosure_against_counting(documents):
    """Every term of every text, by the formula, with parts of values as entities."""
    rng = random.Random(3)
    common = [f"c{chr(97 + i)}" for i in range(26)]
    rows = [(i, " ".join(rng.choices(common, k=6) + [f"r{chr(97 + i % 26)}{chr(97 + i // 26)}"])) for i in range(400)]
    for i in range(12):  # one domain, with a term of its own and one that also stands elsewhere
        rows.append((1000 + i, f"Zorblatt n{i}{'u' * i} wrote from p{chr(97 + i)}@north.org {' '.join(rng.choices(common, k=3))} Fjord"))
    rows += [(2000 + i, f"fjord {' '.join(rng.choices(common, k=5))}") for i in range(4)]
    rows += [(3000 + i, f"Quell host 10.1.2.{i} and {' '.join(rng.choices(common, k=3))}") for i in range(5)]
    rows += [(4000 + i, f"Vexel +1 (234) 555-12{i}4 {rng.choice(common)} 4111 1111 1111 1111") for i in range(4)]
    rows += [(5000, rows[400][1]), (None, rows[-1][1]), (5001, None)]

    parts = {"email": lambda v: v.split("@"), "ip": lambda v: [v.rsplit(".", 1)[0]], "card": lambda v: [re.sub("[^0-9]", "", v)[:6]], "phone": lambda v: [re.sub("[^0-9]", "", v)[:-7]]}
    texts, entities, terms = {t or "" for _, t in rows}, {}, {}
    for t in texts:
        entities[t] = {(kind, i, p) for a, _, kind, b in brute(t) for i, p in enumerate([t[a:b], *parts[kind](t[a:b])])}
        terms[t] = {w.lower() for w in re.findall(r"[^\W\d_]+", t)}
    n, has = len(texts), lambda where, x: sum(x in where[t] for t in texts)
    kinds = {}
    for e in {e for t in texts for e in entities[t]}:
        with_e = [t for t in texts if e in entities[t]]
        if len(with_e) < 2:
            continue
        for w in {w for t in with_e for w in terms[t]}:
            both = sum(w in terms[t] for t in with_e)
            told = math.log(both * n / (len(with_e) * has(terms, w)))
            share = told / math.log(n / len(with_e))
            if both >= 2 and both * told >= 1.5 * math.log(n) and share >= 0.8:
                kinds[e, w] = "term" if share >= 0.95 else "general"
    want = set()
    for doc_id, t in rows:
        firm = brute(t or "")
        for m in re.finditer(r"[^\W\d_]+", t or ""):
            found = [kinds[e, m[0].lower()] for e in entities[t or ""] if (e, m[0].lower()) in kinds]
            if found and not any(a < m.end() and m.start() < b for a, *_, b in firm):
                want.add((doc_id, "term" if "term" in found else "general", m.start(), m.end()))
    got = set()
    for r in digest(find(documents(rows).repartition(3))).collect():
        for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s):
            if kind in ("term", "general"):
                got.add((r["doc_id"], kind, int(a), int(b)))
    assert got == want
    text = dict(rows)
    named = {(kind, text[d][a:b]) for d, kind, a, b in got if d is not None}
    assert {("term", "Zorblatt"), ("general", "Fjord"), ("term", "Quell"), ("term", "Vexel")} <= named
    clean = {r["doc_id"]: r["text"] for r in sanitised(documents(rows)).collect()}
    assert clean[1001].startswith("[REMOVED]") and clean[1001].endswith("[Xx]") and clean[2001] == text[2001]


def test_terms_of_the_whole_text(documents):
    """Far from the entity, of any length, at every place."""
    filler = " ".join(["plain"] * 30)
    rows = [(i, f"text w{chr(97 + i % 26)}{chr(97 + i // 26)} about plain weather") for i in range(300)]
    rows += [(1000 + i, f"Dear Zorblatt, {filler} ann@home.org {filler} yours {'pq' * (i + 1)} 王, Qy and ZORBLATT") for i in range(3)]
    got = {r["doc_id"]: r["spans"] for r in digest(find(documents(rows))).collect()}
    text = dict(rows)[1001]
    marked = [text[int(a) : int(b)] for kind, a, b in (s.split(":") for s in got[1001].split(",")) if kind == "term"]
    assert [t for t in marked if t.lower() in ("zorblatt", "qy", "王")] == ["Zorblatt", "王", "Qy", "ZORBLATT"] and "plain" not in marked


def test_other_matches_do_not_end_the_context(documents):
    """A number between a name and a card, and an address between a name and another address."""
    rows = [(i, f"text w{chr(97 + i % 26)}{chr(97 + i // 26)} about plain weather") for i in range(300)]
    rows += [(1000 + i, f"Zorblatt, 42, card 4111 1111 1111 1111 {'pq' * (i + 1)}") for i in range(3)]
    rows += [(2000 + i, f"Quixnote a{i}@x.com, bob@home.org {'vw' * (i + 1)}") for i in range(3)]
    clean = {r["doc_id"]: r["text"] for r in sanitised(documents(rows)).collect()}
    assert all("Zorblatt" not in clean[1000 + i] and "Quixnote" not in clean[2000 + i] for i in range(3))


def test_empty_table(documents):
    assert digest(find(documents([]))).collect() == []
    assert pii.KINDS[:4] == list(PLAIN)
