"""One-pass scans against one test a word, and the words that signatures need."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vigilore.functions.scanning import Words, needed_literals, on
from vigilore.knowledge import HUNTS, LOGIN_SIGNATURES, SHELL_SIGNATURES
from vigilore.operators import extract

SIGNS = (*SHELL_SIGNATURES, *LOGIN_SIGNATURES)


@pytest.mark.parametrize("whole", [True, False])
def test_words(spark, whole):
    """Words that overlap, begin together, hold marks or stand in longer ones."""
    words = ["at", "at.exe", "ate", "-o", "-out", "e.ex", "$_post", ".php", "x", "exe", "/create", "a+b"]
    r = random.Random(whole)
    texts = ["", "at.exe", "chat.exe ate", "x-out.php$_post", "at_", *["".join(r.choice(["at", ".", "exe", "-o", "ut", " ", "x", "$_post", "a+b", "/create", "é", "_", "php", "9"]) for _ in range(r.randint(1, 12))) for _ in range(300)]]

    def there(w, text):
        if not whole:
            return w in text
        return re.search(("(?<![a-z0-9_])" if w[0].isalnum() else "") + re.escape(w) + ("(?![a-z0-9_])" if w[-1].isalnum() else ""), text) is not None

    scan = Words(words, whole)
    found = on(scan.found(F.col("t")), lambda f: F.array(*[scan.has(f, w) for w in words]))
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", found.alias("f")).collect():
        assert row.f == [there(w, row.t) for w in words], row.t


def test_hunts_equal_single_word_tests(spark):
    r = random.Random(3)
    parts = sorted({w for own in HUNTS.values() for way in own for w in way}) + ["PowerShell", "er", "-", "Plain", "İ"]
    texts = [None, *["".join(r.choice([p, p.upper()]) + r.choice([" ", "  ", "", ";"]) for p in r.choices(parts, k=r.randint(1, 6))) for _ in range(400)]]

    def word(w, t):
        return re.search(("(?<![a-z0-9_])" if w[0].isalnum() else "") + re.escape(w) + ("(?![a-z0-9_])" if w[-1].isalnum() else ""), t) is not None

    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.lower(F.coalesce("t", F.lit(""))).alias("low"), extract.hunt_matches(F.col("t")).alias("h")).collect():
        assert row.h == [name for name, ways in HUNTS.items() if any(all(word(w, row.low) for w in way) for way in ways)], row.t


def test_needed_literals():
    assert needed_literals(r"c99(mad|shell|\s)") == [["c99"]] and needed_literals(r"FilesMAn|FilesMan") == [["filesman", "filesman"]]
    assert needed_literals(r"<title>.*?(Shell|Web\s*Shell).*?</title>") == [["<title>"], ["shell", "shell"], ["</title>"]]
    assert needed_literals(r"ab?cd+e(x|yz)?[fg]hi{2}") == [["cd"]] and needed_literals(r"(ab|c\s)de") == [["ab", ""][:1], ["de"]][1:]
    assert sum(bool(needed_literals(p)) for p, _, _ in SIGNS) == len(SIGNS)


def test_pages_equal_single_patterns(spark):
    r = random.Random(5)
    bits = ["<title>", "</title>", "b374k", "C99 ", "c99mad", "r57", "shell", "Web Shell", "WSO 2.1", "FilesMan", "<?php system (x)", "<?php exec(y)", "eval( base64_decode (", "Dragon", "Alfa", "Panel", "login", "Mini", "priv8", "pryv8", "Symlink", "Bypass", "\n", " ", "hacked", "method post action auth", "é"]
    pages = [(i, "".join(r.choice([b, b.upper(), b.lower()]) for b in r.choices(bits, k=r.randint(0, 9)))) for i in range(500)] + [(-1, None)]
    got = {x.page_id: x for x in extract.page_signatures(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    hits = 0
    for i, html in pages:
        seen = [(label, w) for p, label, w in SHELL_SIGNATURES if re.search("(?ia)" + p, html or "")]
        login = sum(w == "high" and re.search("(?ia)" + p, html or "") is not None for p, _, w in LOGIN_SIGNATURES)
        assert (got[i].high, got[i].medium, got[i].low, got[i].login_high, got[i].families) == (*[sum(w == x for _, w in seen) for x in ("high", "medium", "low")], login, [label for label, _ in seen]), html
        hits += len(seen) + login
    assert hits > 200
