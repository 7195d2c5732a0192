"""Personal data against the contract's plain patterns, and on very long runs."""

import random
import re
import time

from roadspark.llm.pii import BASE_KINDS, spans_of

# The contract's patterns, restarted at every character as the library does it.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(5)
    for alphabet, size in (("a@.b-", 14), ("a_@.1 ", 30), ("12.", 16), ("0123456789 -", 60), ("+1(2) .-3", 24), ("41 -+.@a", 80)):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(size)))
            assert [s[:3] for s in spans_of(text) if s[0] in BASE_KINDS] == plain_spans(text), text


def test_words_nearby_decide():
    assert [s[0] for s in spans_of("her SSN: 123-45-6789")] == ["ssn"]
    assert spans_of("part 123-45-6789") == [] and spans_of("SSN 000-45-6789") == []
    score = lambda t: spans_of(t)[0][4]
    assert score("version 10.0.0.1") < score("see 10.0.0.1") < score("server at 10.0.0.1")
    assert [s[0] for s in spans_of("order serial version release example 1.2.3.4 then a@b.c")] == ["email", "ip"]


def test_long_texts_take_linear_time():
    n = 1_000_000
    for text in ("7" * n, "a" * n, "0" * n, "." * n, "7" * n + ".1", "a" * n + "@", "0" * n + ".1.1.1", "a@" * (n // 2), "a." * (n // 2) + "@b.c", "1." * (n // 2), "+1" + "(" * n, "1 " * (n // 2), "x@y" + ".z" * (n // 2)):
        began = time.time()
        spans_of(text)
        assert time.time() - began < 2, (text[:5], time.time() - began)
    assert ("ip", 0, 5_007) in [s[:3] for s in spans_of("0" * 5_000 + "1.1.1.1")]
