"""A small labelled table of personal data in context, made from templates.

Each row is a text with one span and a label: 1 where the span is personal data or a
secret, 0 where it only looks like it.  Values are drawn with a fixed seed, so the
table is the same in every run; its size is bounded by ``rows``.
"""

from __future__ import annotations

import json
import random
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 4_000
_SCHEMA = "array<struct<text:string,kind:string,start:bigint,end:bigint,label:int>>"


def _word(r: random.Random) -> str:
    return "".join(r.choice(("th", "an", "er", "lo", "mi", "ka", "ente", "sch", "ou", "re", "po", "ta")) for _ in range(r.randint(1, 3)))


def _prose(r: random.Random) -> str:
    return " ".join(_word(r) for _ in range(r.randint(2, 6)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _number(r: random.Random, n: int, valid: bool) -> str:
    """``n`` digits that pass the check digit's rule, or fail it."""
    body = r.choice("3456") + _digits(r, n - 2)
    weighed = [2 * int(c) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body))]
    right = -sum(x - 9 if x > 9 else x for x in weighed) % 10
    return body + str(right if valid else (right + r.randint(1, 9)) % 10)


def _grouped(r: random.Random, digits: str, sep: str, size: int = 4) -> str:
    return sep.join(digits[i : i + size] for i in range(0, len(digits), size))


def _mixed(r: random.Random, n: int, letters: str = string.ascii_letters + string.digits) -> str:
    return "".join(r.choice(letters) for _ in range(n - 2)) + r.choice(string.digits) + r.choice("abcdef")


def _octets(r: random.Random) -> list[str]:
    return [str(r.randint(1, 255)) for _ in range(4)]


def _positives():
    """(kind, words before or None for none, value)."""
    at, dot = ("(at)", " (at) ", "[at]", " [at] ", " at ", " AT ", "{at}", " @ "), ("(dot)", " (dot) ", "[dot]", " [dot] ", " dot ", " DOT ", ".", "[.]")

    def email(r):
        a, d = r.choice(at), r.choice(dot)
        if a in (" at ", " AT ") and d == ".":
            d = " dot "
        local = r.choice((f"{_word(r)}.{_word(r)}", f"{_word(r)}{r.randint(1, 99)}", f"{_word(r)}.{r.randint(1, 99)}", _word(r)))
        return f"{local}{a}{_word(r)}{r.randint(1, 9) if r.random() < 0.5 else ''}{d}{r.choice(('com', 'org', 'net', 'de'))}"

    def ip(r):
        if r.random() < 0.5:
            return r.choice((" . ", "[.]", "(.)", " dot ", ". ")).join(_octets(r))
        groups = [f"{r.randrange(65536):x}" for _ in range(8)]
        return ":".join(groups) if r.random() < 0.5 else f"{groups[0]}:{groups[1]}::{groups[2]}" if r.random() < 0.5 else f"fe80::{groups[3]}:{groups[4]}" if r.random() < 0.7 else f"::{groups[3]}:{groups[4]}:{groups[5]}"

    def card(r):
        return _grouped(r, _number(r, r.choice((15, 16, 16, 16)), True), r.choice((".", " - ", "  ", "/", "_", ". ")))

    def typo(r):
        return _grouped(r, _number(r, 16, False), r.choice(("", " ", "-")))

    def phone(r):
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return r.choice((f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{r.randint(1, 99)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"0{_digits(r, 2)}/{b}{c}"))

    def assigned(r):
        return f"{r.choice(('token', 'secret', 'password', 'passwd', 'api_key', 'apikey', 'access_key', 'API-KEY', 'pwd'))}{r.choice((' = ', '=', ': ', ':'))}{(q := r.choice(('', chr(34), chr(39))))}{_mixed(r, r.choice((8, 12, 20, 32, 40)), r.choice((string.ascii_letters + string.digits, '0123456789abcdef', string.ascii_letters + string.digits + '!$%-')))}"

    def bare(r):
        return r.choice(("sk_live_", "ghp_", "AKIA", "", "")) + _mixed(r, r.randint(28, 44))

    plain = (None, None)
    return [
        ("email", ("mail", "write to", "contact:", *plain), email), ("ip", ("ip", "host", "from", "server at", *plain), ip), ("card", ("card", "visa", "credit card number", *plain), card), ("card", ("card number", "visa", "credit card"), typo),
        ("phone", ("call", "phone:", "tel", "fax", "mobile", *plain), phone), ("secret", ("the", "set", *plain), assigned), ("secret", ("key", "bearer", "credential", "login"), bare),
    ]


def _negatives():
    month = lambda r: f"{r.randint(1, 12):02d}"
    year = lambda r: str(r.randint(1900, 2030))
    return [
        ("email", ("look", "arrive", "laugh", None), lambda r: f"{_word(r)} at {_word(r)}.{_word(r)}"),
        ("email", ("stay", "meet", None), lambda r: f"{_word(r)} at {_word(r)}.{_word(r)}.{_word(r)}"),
        ("email", (None,), lambda r: f"{_word(r)} at {r.choice(('[.]', ' dot ', '.', '(.)')).join(_octets(r))}"),
        ("email", ("price", "sold", None), lambda r: f"{r.randint(1, 99)} @ {r.randint(1, 99)}.{r.randint(10, 99)}"),
        ("ip", ("version", "release", "v", "section", None), lambda r: " . ".join(str(r.randint(0, 30)) for _ in range(r.randint(5, 6)))),
        ("ip", ("version", "section", "part"), lambda r: ". ".join(str(r.randint(0, 20)) for _ in range(4))),
        ("ip", ("host", "ip", "from", None), lambda r: ".".join(r.sample([*_octets(r)[:3], str(r.randint(256, 999))], 4))),
        ("phone", ("call", "phone", None), lambda r: f"+{r.randint(1, 9)} {_digits(r, 3)} {_digits(r, 3)}"),
        ("ip", ("total", "sum", None), lambda r: " . ".join(str(r.randint(256, 9999)) for _ in range(4))),
        ("ip", ("time", "at", None), lambda r: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}"),
        ("ip", ("class", "use", None), lambda r: f"{r.choice('abcdef')}::{r.choice(('add', 'bee', 'face', 'a'))}"),
        ("ip", ("mac", "mac:"), lambda r: ":".join(f"{r.randrange(256):02x}" for _ in range(6))),
        ("card", ("order", "invoice", "ref", "serial", None, None, None), lambda r: _grouped(r, _number(r, r.choice((12, 14, 16, 16, 16, 18)), False), r.choice(("", "", "", " ", "-", ".")))),
        ("card", ("order", "invoice number", "isbn", "tracking id"), lambda r: _grouped(r, _number(r, 16, True), r.choice((".", "_", "/")))),
        ("card", (None, None), lambda r: _digits(r, r.choice((12, 13, 14, 15, 16, 16, 17, 18)))),
        ("card", ("time", "date", None), lambda r: f"{year(r)}{month(r)}{month(r)}{_digits(r, 6)}"),
        ("card", (None, "numbers"), lambda r: " ".join(str(i) for i in range(1, r.randint(10, 16)))),
        ("phone", ("date", "on", None), lambda r: f"{year(r)}-{month(r)}{month(r)}-{year(r)}"),
        ("phone", ("from", "years", None), lambda r: f"{year(r)} - {year(r)}-{year(r)}"),
        ("phone", ("isbn", "order", "item"), lambda r: f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}"),
        ("phone", ("sum", "total"), lambda r: f"{r.randint(10, 999)} {_digits(r, 3)} {_digits(r, 3)}"),
        ("phone", (None,), lambda r: f"{_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)}"),
        ("secret", ("the", None), lambda r: f"{r.choice(('token', 'password', 'secret', 'pwd'))}: {r.choice(('please', 'manual', 'required', 'optional', 'unknown', _word(r) + _word(r) + _word(r)))}"),
        ("secret", ("commit", "sha1", "md5", "checksum", "hash"), lambda r: _mixed(r, r.choice((32, 40)), "0123456789abcdef")),
        ("secret", (None, "call", "name"), lambda r: "".join(_word(r).title() for _ in range(8)) + str(r.randint(1, 9))),
        ("secret", (None,), lambda r: r.choice("ax") * r.randint(20, 30) + "1"),
        ("secret", (None, "id", "file"), lambda r: "_".join(_word(r) for _ in range(6)) + f"_{r.randint(1, 99)}"),
    ]


def labelled_texts(spark: SparkSession, rows: int = ROWS, seed: int = 11) -> DataFrame:
    """(text, kind, start, end, label): ``rows`` texts, half of them with label 1, in turn from all templates."""
    r, out = random.Random(seed), []
    for label, templates in ((1, _positives()), (0, _negatives())):
        for i in range(rows // 2):
            kind, before, value = templates[i % len(templates)]
            cue = r.choice(before)
            head = "" if r.random() < 0.05 else f"{_prose(r)}{r.choice((' ', ', ', '. '))}" + (f"{cue} " if cue else "")
            shown = value(r)
            tail = r.choice((" ", " ", ", ", ".", "")) + _prose(r) if r.random() < 0.9 else ""
            tail = tail if not tail or tail[0] in " ,." else f" {tail}"
            out.append({"text": head + shown + tail, "kind": kind, "start": len(head), "end": len(head) + len(shown), "label": label})
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(out)), _SCHEMA)).alias("x")).select("x.*")
