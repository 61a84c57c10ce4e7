from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from fieldloom.llm import pii
from fieldloom.llm.shared import table
from tests.compare import SMALL
from tests.llm import odd

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9_])",
    "idnumber": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Za-z0-9+/_-]{32,}",
}


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind: str, v: str) -> bool:
    digits = re.sub("[^0-9]", "", v)
    match kind:
        case "ip":
            return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in v.split("."))
        case "card":
            return 12 <= len(digits) <= 19 and luhn(digits)
        case "phone":
            return 9 <= len(digits) <= 15
        case "iban":
            v = v.replace(" ", "")
            return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
        case "secret":
            return bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v))
    return True


def by_hand(text: str | None) -> list[tuple[int, int, int, str, int]]:
    text, out = text or "", []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            around = text[max(0, m.start() - pii.BEFORE) : m.start()] + " " + text[m.end() : m.end() + pii.AFTER]
            score = pii.SCORES[kind] + pii.BOOST * bool(re.search(pii.CONTEXT[kind], around.lower()))
            if holds(kind, m[0]) and (kind in pii.BASE or score >= pii.LEAST_SCORE):
                out.append((m.start(), order, m.end(), kind, score))
    return sorted(out)


def row(doc_id: int | None, text: str | None) -> str:
    found = by_hand(text)
    shown = lambda some: ",".join(f"{k}:{s}:{e}" for s, _, e, k, _ in some)
    base = [x for x in found if x[1] < 4]
    return str((doc_id, *(sum(x[3] == k for x in found) for k in pii.BASE), hashlib.sha256(shown(base).encode()).hexdigest(), shown(found), ",".join(str(x[4]) for x in found)))


def shown(df) -> list[str]:
    return sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans, r.scores)) for r in df.collect())


CASES = [
    "a.b+c@mail.example.org x@y@z.com a@b.c_d@e.f @no.com a@b a@b. a@b.c.",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 1.2.3 1..2.3.4",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 4012888888881881 378282246310005 12 34",
    "4111  1111 1111 1111 and 4111111111111111 5 and 0000000000000000000000",
    "call +1 (555) 010-9999 or +44 20 7946 0958 or +12 3 or +1234567890123456 or ++1 23.45.67.89",
    "IBAN DE89370400440532013000, GB82WEST12345698765432 GB82WEST12345698765433 XX00AAAAAAAAAAAAAAA",
    "DE89 3704 0044 0532 0130 00, GB82 WEST 1234 5698 7654 32. aDE89 3704 0044 0532 0130 00 DE89370400440532013000X DE89  3704 0044",
    'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" and ' + "z" * 60 + " f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda secret " + "y" * 40,
    "ssn 123-45-6789; " + "z" * 60 + " 123-45-6789 " + "z" * 60,
    "🙂🙂 é jo@ex.org 🙂 1.1.1.1 tel +1 555 010 9999",
    "a" * 20_000 + "@" + "b" * 20_000,
    "1" * 30_000 + "." + "2" * 100 + ".3.4",
    "1.1.1.1 " * 500 + "a@b.cd " * 500,
    "+" * 5000 + "1" * 50 + " " * 5000 + "2",
]


def test_cases_by_hand(spark):
    docs = odd.documents(spark, [(i, t, None, None) for i, t in enumerate(CASES)])
    assert shown(pii.find(docs)) == sorted(row(i, t) for i, t in enumerate(CASES))


def test_random_texts_by_hand(spark):
    rng = random.Random(1)
    bits = ["a", "Z", "9", "12", "4111 1111 1111 1111", "@", ".", "..", "-", "+", " ", "(", ")", "_", "é", "🙂", "\n", "x@y.z", "1.2.3.4", "+12345678901", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "123-45-6789", "ssn ", "token "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(1500)]
    docs = odd.documents(spark, [(i, t, None, None) for i, t in rows])
    assert shown(pii.find(docs)) == sorted(row(i, t) for i, t in rows)


@pytest.mark.parametrize("where", ["odd", "table"])
def test_tables_by_hand(spark, where):
    docs = odd.crowded(odd.documents(spark)) if where == "odd" else table(spark, SMALL, "documents")
    assert shown(pii.find(docs)) == sorted(row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def by_hand_redacted(text: str | None) -> str | None:
    merged: list[list] = []
    for s, _, e, kind, _ in by_hand(text):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, kind])
    for s, e, kind in reversed(merged):
        text = f"{text[:s]}[{kind.upper()}]{text[e:]}"
    return text


def test_the_stage_replaces_spans_and_nothing_else(spark):
    rows = [*enumerate(CASES), (97, None), (98, ""), (None, "x@y.zz")]
    docs = odd.crowded(odd.documents(spark, [(i, t, "en", "a") for i, t in rows]))
    got = pii.redact(docs)
    assert got.dtypes == docs.dtypes
    assert odd.sorted_rows(got.drop("text")) == odd.sorted_rows(docs.drop("text"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(str((i, by_hand_redacted(t))) for i, t in rows)


def test_no_python_on_the_main_path(spark):
    plan = pii.find(odd.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert pii.find(odd.empty(spark)).count() == 0 and pii.redact(odd.empty(spark)).count() == 0


def seconds(run) -> float:
    began = time.time()
    run()
    return time.time() - began


def test_time_grows_with_the_spans_alone(spark):
    """32,000 spans in one text take seconds, and four times as many as four times fewer; quadratic work would take minutes."""
    text = lambda n: "".join(f"user{i % 977} wrote to a{i}@mail.example.org, " for i in range(n))
    rows = {n: odd.documents(spark, [(1, text(n), "en", "a")]).coalesce(1).cache() for n in (500, 8_000, 32_000)}
    for work in (pii.find, pii.redact):
        took = {n: seconds(lambda docs=docs: work(docs).write.format("noop").mode("overwrite").save()) for n, docs in rows.items()}
        assert took[32_000] < 20 and took[32_000] < 12 * max(took[8_000], 0.5)
    assert pii.find(rows[32_000]).first().n_email == 32_000
    assert pii.redact(rows[8_000]).first().text == by_hand_redacted(text(8_000))
    print(took)
