import hashlib
import os
import random

import duckdb
import pytest
import regex

from cellweave.llm.licences import _MIT, DIGESTS, KNOWN, PARTED, RUNNING, SPELLINGS, oracle, scan

FOLDER = "/usr/share/common-licenses"


def is_notice(line):
    """A copyright notice, told word by word."""
    if len(line) > 200:
        return False
    start = line.find("(c)")
    if start >= 0 and not any(c.isalnum() or c == "©" for c in line[:start]) and line[start + 3 :].lstrip(" ")[:1].isdigit():
        return True
    line = regex.sub(r"^[^\p{L}\p{N}©]+", "", line)
    if line.startswith("©") or regex.fullmatch(r"all rights reserved[^\p{L}\p{N}]*", line):
        return True
    words = line.split(" ")
    if words[0] in ("portions", "parts") and len(words) > 1:
        return regex.match(r"copyright(\P{L}|$)", " ".join(words[1:])) is not None
    if not regex.match(r"copyright(\P{L}|$)", line):
        return False
    after = regex.match(r"copyright[ ,]+(\p{L}+)", line)
    return not (after and after[1] in RUNNING)


def plain(text):
    lines = [x for x in regex.split(r"[\r\n]+", (text or "").lower()) if not is_notice(x)]
    words = [SPELLINGS.get(w, w) for w in regex.findall(r"[\p{L}\p{N}]+", " ".join(lines))]
    joined = f" {' '.join(words)} "
    for a, b in PARTED:
        joined = joined.replace(f" {a} ", f" {b} ")
    return hashlib.sha256(joined.strip().encode()).hexdigest()


def known():
    found = {d: i for i, d in DIGESTS.items()}
    for i, title, body in KNOWN:
        found |= {plain(body): i, plain(f"{title}\n\n{body}"): i}
    return found


def test_entire_texts_in_other_spellings(spark):
    wrapped = "MIT LICENSE\n\nCopyright (c) 2021 Some One\rCopyright The Authors\n© 2022 Another\n * Portions Copyright Acme, Inc.\nAll rights reserved.\n" + _MIT.replace("sublicense", "sub-license").replace(" ", "\n  ", 30).upper()
    rows = [(1, _MIT), (1, _MIT), (2, wrapped), (3, _MIT + " and more"), (None, None), (4, ""), (5, "...\n"), (6, KNOWN[-1][2].replace("License", "Licence")), (7, "x" * 200000)]
    rows += [(8, wrapped.replace("\n", "\r")), (9, "Copyright (c) 2020 Acme. " + _MIT.replace("\n", " ")), (10, "Copyright notice\nCopyright holders")]
    df = spark.createDataFrame([(*x, "d", "l") for x in rows], "doc_id long, text string, digest string, licence string")
    got = sorted((str(x.id), x.licence, x.digest) for x in scan(df).collect())
    assert got == sorted([(str(i), known().get(plain(t)), plain(t)) for i, t in rows], key=lambda x: (x[0], x[2]))
    of = {i: licence for i, licence, _ in got}
    assert [of[str(i)] for i in (1, 2, 3, 6, 7, 8, 9, 10)] == ["MIT", "MIT", None, "Apache-2.0 notice", None, "MIT", None, None]
    empty = hashlib.sha256(b"").hexdigest()
    assert [d == empty for i, _, d in got if i in ("4", "5", "None", "9", "10")] == [False, True, True, False, True]
    assert scan(df.limit(0)).count() == 0


def test_random_texts_against_plain_rules_and_sql(spark):
    r = random.Random(9)
    parts = ["Copyright", "copyright notice", "(c)", "2020", "©", "All rights reserved", ".", ",", "\n", "\r\n", "\r", " ", "  ", "Portions", "Licence", "sub-license", "per cent", "É", "word", "*", "#", "x" * 90]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 25)))) for i in range(1500)]
    got = dict((x.id, x.digest) for x in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [got[i] for i, _ in rows] == [plain(t) for _, t in rows]
    with duckdb.connect() as c:
        c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO documents VALUES (?, ?)", [*rows, (-1, _MIT)])
        sql = {d: (g, licence) for d, g, licence in c.sql(oracle()).fetchall()}
    assert {i: g for i, (g, _) in sql.items() if i >= 0} == got and sql[-1][1] == "MIT"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the system's licence texts are not here")
def test_long_licences_by_their_published_texts(spark):
    names = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0", "Artistic": "Artistic-1.0-Perl"}
    files = [f for f in sorted(os.listdir(FOLDER)) if names.get(f, f) in DIGESTS]
    texts = [(k, open(f"{FOLDER}/{f}").read()) for k, f in enumerate(files)]
    got = {x.id: x.licence for x in scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(files))] == [names.get(f, f) for f in files] and len(files) == len(DIGESTS)


def test_no_python_runs(spark):
    plan = scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
