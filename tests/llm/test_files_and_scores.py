"""Archives and licences as found elsewhere; what the models learn."""

import base64
import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.llm import license_scan, lm, toxicity, warc
from tabulens.llm.common import scratch_path
from tabulens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def gz(raw):
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def made(kind, name, block, *more, version="WARC/1.0"):
    head = [version, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2024-01-02T03:04:05Z", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


PAGE = b"<html>caf\xc3\xa9</html>" * 90
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(PAGE)
B32 = base64.b32encode(hashlib.sha1(PAGE).digest()).decode()
RESPONSE = "content-type: application/http; msgtype=response"
FOUND = [
    made("warcinfo", "info", b"software: x\r\n", "Content-Type: application/warc-fields", version="WARC/1.1"),
    made("request", "ask", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "warc-target-uri: http://a/"),
    made("response", "r1", HTTP + PAGE, RESPONSE, "warc-target-uri: http://a/\r\n very-long", f"WARC-Payload-Digest: sha1:{B32}"),
    made("metadata", "m", b"fetchTimeMs: 3\r\n"),
    made("response", "r2", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n", RESPONSE, f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'abc').hexdigest().upper()}"),
    made("revisit", "v", HTTP, RESPONSE, "WARC-Refers-To: <urn:uuid:r1>", f"WARC-Payload-Digest: sha1:{B32}"),
    made("resource", "x", b"plain", "WARC-Payload-Digest: md5:0"),
]


def archive(spark, *parts, records=None):
    """A manifest of one file of these bytes."""
    folder = scratch_path(spark, "made").removeprefix("file://")
    os.makedirs(folder)
    path, data = f"{folder}/a.warc.gz", b"".join(parts)
    with open(path, "wb") as out:
        out.write(data)
    return spark.createDataFrame([(f"file://{path}", len(data), records)], "path string, bytes long, records long")


@pytest.mark.parametrize("step", [100, 1 << 20])
def test_archive_from_elsewhere(spark, step):
    got = {r.record_id: r for r in warc.read_archives(archive(spark, *map(gz, FOUND)), range_bytes=step).collect()}
    of = lambda name: got[f"<urn:uuid:{name}>"]
    assert len(got) == len(FOUND) and {r.record_type for r in got.values()} == {"warcinfo", "request", "response", "metadata", "revisit", "resource"}
    sha1 = hashlib.sha1(PAGE).hexdigest()
    assert (of("r1").payload, of("r1").payload_digest, of("r1").digest_ok, of("r1").url) == (PAGE, sha1, True, "http://a/ very-long")
    assert (of("v").payload, of("v").payload_bytes, of("v").payload_digest, of("v").refers_to_id) == (None, len(PAGE), sha1, "<urn:uuid:r1>")
    assert of("r2").digest_ok is None and of("m").payload == b"fetchTimeMs: 3\r\n" and of("x").payload_digest == hashlib.sha1(b"plain").hexdigest()
    assert all(r.page_id is None and r.refers_to is None for r in got.values())


def broken():
    whole = [gz(r) for r in FOUND]
    checksum = whole[2][:-8] + b"\0\0\0\0" + whole[2][-4:]
    other = made("response", "bad", HTTP + PAGE, RESPONSE, f"WARC-Payload-Digest: sha1:{'0' * 40}")
    return {
        "wrong checksum": [*whole[:2], checksum, *whole[3:]], "cut off": [*whole[:2], whole[2][:-20]], "gap": [*whole[:2], b"junk", *whole[2:]],
        "no start": [b"junk", *whole], "junk at the end": [*whole, b"junk"], "wrong digest": [*whole[:2], gz(other), *whole[3:]],
        "damaged head": [*whole[:2], whole[2][:10] + b"\xff" * 8 + whole[2][18:], *whole[3:]],
    }


@pytest.mark.parametrize("kind", list(broken()))
def test_damaged_archives_are_errors(spark, kind):
    manifest = archive(spark, *broken()[kind])
    for step in (64, 1 << 20):
        with pytest.raises(Exception, match="Damaged"):
            warc.read_archives(manifest, range_bytes=step).collect()
    assert warc.read_archives(manifest, damaged="skip").count() >= 2


def test_missing_records_are_errors(spark):
    manifest = archive(spark, *map(gz, FOUND), records=len(FOUND) + 1)
    with pytest.raises(warc.Damaged, match="7 of 8"):
        warc.checked(manifest, warc.read_archives(manifest))


COMMON = "/usr/share/common-licenses"
MIT = """MIT License

Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2024, Somebody
All rights of the authors are stated below.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS ARE DISCLAIMED.
"""


def test_whole_licence_files_govern(spark):
    texts = {"MIT": ("LICENSE", MIT), "BSD-3-Clause": ("COPYING.txt", BSD)}
    for licence, name, own in (("Apache-2.0", "Apache-2.0", "LICENSE.md"), ("GPL-2.0", "GPL-2", "COPYING"), ("GPL-3.0", "GPL-3", "COPYING"), ("LGPL-3.0", "LGPL-3", "COPYING.LESSER"), ("MPL-2.0", "MPL-2.0", "licence"), ("CC0-1.0", "CC0-1.0", "LICENSE")):
        if os.path.exists(f"{COMMON}/{name}"):
            with open(f"{COMMON}/{name}") as file:
                texts[licence] = (own, file.read())
    files = [(f"{k}/{name}", text) for k, (name, text) in texts.items()] + [(f"{k}/src/x.c", "int main() { return 0; }") for k in texts] + [("other/LICENSE", "nothing of the kind"), ("other/y.c", "int y;")]
    files += [(f"prose/{i}", f"a text of {i} with words in it") for i in range(100)]
    df = spark.createDataFrame(files, "path string, body string")
    got = {r.path: (r.licence, r.inherited_licence) for r in license_scan.scan(df, "path", F.col("path"), "body").collect()}
    assert {k: got[f"{k}/{name}"][0] for k, (name, _) in texts.items()} == {k: k for k in texts}
    assert {k: got[f"{k}/src/x.c"] for k in texts} == {k: (None, k) for k in texts}
    assert got["other/y.c"] == (None, None) and got["prose/1"] == (None, None)


BSD_2 = BSD[: BSD.index("3. Neither")] + BSD[BSD.index("THIS SOFTWARE") :]
LGPL_21 = """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 2.1, February 1999

 Copyright (C) 1991, 1999 Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.

[This is the first released version of the Lesser GPL.  It also counts
 as the successor of the GNU Library Public License, version 2, hence
 the version number 2.1.]
"""
ZLIB = """Copyright (c) 2024 Somebody

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""


def test_licences_that_look_alike(spark):
    """Files as they are found: a rights line among clauses, clauses that two licences share, other versions and other parts."""
    files = {
        "bsd3": ("BSD-3-Clause", BSD.replace("All rights of the authors are stated below.", "All rights reserved.")), "bsd2": ("BSD-2-Clause", BSD_2.replace("All rights of the authors are stated below.", "All rights reserved.")),
        "lgpl21": ("LGPL-2.1", LGPL_21), "by3": ("CC-BY-3.0", "Creative Commons Attribution 3.0 Unported\n\nThis work is licensed under a Creative Commons Attribution 3.0 Unported License."),
        "bysa3": ("CC-BY-SA-3.0", "This work is licensed under a\nCreative Commons Attribution-ShareAlike 3.0 Unported License."), "bynd4": ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
        "zlib": ("Zlib", ZLIB), "epl2": ("EPL-2.0", "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"), "own": ("Proprietary", "Copyright 2024 Somebody.\nAll rights reserved."),
        "gpllib": ("GPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
        "neither": (None, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    }
    rows = [(f"{k}/LICENSE", text) for k, (_, text) in files.items()] + [(f"{k}/src/x.c", "int main() { return 0; }") for k in files] + [(f"prose/{i}", f"a text of {i} with words in it") for i in range(200)]
    got = {r.path: (r.licence, r.inherited_licence) for r in license_scan.scan(spark.createDataFrame(rows, "path string, body string"), "path", F.col("path"), "body").collect()}
    assert {k: got[f"{k}/LICENSE"][0] for k in files} == {k: licence for k, (licence, _) in files.items()}
    assert {k: got[f"{k}/src/x.c"] for k in files} == {k: (None, licence) for k, (licence, _) in files.items()}


def test_several_files_govern_a_directory(spark):
    """A rights line gives way to a licence; of licences the one with the higher cosine governs, then the first id; repeated rows change nothing."""
    exact, part = license_scan.TEMPLATES["MIT"][1], "Licensed under the Apache License, Version 2.0, as said elsewhere."
    rows = [("a/COPYRIGHT", "All rights reserved."), ("a/LICENSE", part), ("b/LICENSE", exact), ("b/COPYING", part), ("c/LICENSE.a", "Licensed under the ISC License."), ("c/LICENSE.b", "Released under the MIT License."), ("c/LICENSE.b", "Released under the MIT License.")]
    rows += [(f"{d}/x", "int x;") for d in "abc"] + [(f"prose/{i}", f"a text of {i} with words in it") for i in range(200)]
    got = {r.path: r.inherited_licence for r in license_scan.scan(spark.createDataFrame(rows, "path string, body string"), "path", F.col("path"), "body").collect()}
    assert {d: got[f"{d}/x"] for d in "abc"} == {"a": "Apache-2.0", "b": "MIT", "c": "ISC"}


def test_other_templates(spark):
    df = spark.createDataFrame([("d/LICENSE", "You may bake this bread freely and share it's loaf"), ("d/e", "x")], "path string, body string")
    got = {r.path: r for r in license_scan.scan(df, "path", F.col("path"), "body", {"Bread": ("You may bake this bread freely and share it's loaf",)}).collect()}
    assert got["d/LICENSE"].licence == "Bread" and got["d/e"].inherited_licence == "Bread"


def test_pairs_of_terms_are_learned():
    """Both words or neither are toxic: no sum of weights can tell, pairs can."""
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2, (4000, 2))
    y = (both[:, 0] == both[:, 1]).astype(float)
    rows, terms = np.nonzero(both)
    noise = np.repeat(np.arange(4000), 2), 2 + rng.integers(0, 20, 8000)
    rows, terms = np.concatenate([rows, noise[0]]), np.concatenate([terms, noise[1]])
    train = rows < 3000
    machine = toxicity.fit(rows[train], terms[train], y[:3000], 22)
    of = lambda m: np.mean((m.scores(rows, terms, 4000)[3000:] >= 0.5) == y[3000:])
    linear = toxicity.Machine(machine.w0, machine.w, np.zeros_like(machine.v))
    assert of(machine) > 0.95 and of(linear) < 0.8


def test_margins_are_sums_over_pairs():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    texts = [[0, 2, 5], [1], [], [0, 1, 2, 3, 4, 5]]
    rows, terms = np.repeat(np.arange(4), [len(t) for t in texts]), np.array([x for t in texts for x in t])
    want = [0.3 + sum(machine.w[i] for i in t) + sum(machine.v[i] @ machine.v[j] for k, i in enumerate(t) for j in t[k + 1 :]) for t in texts]
    assert machine.margins(rows, terms, 4) == pytest.approx(want)


def test_toxicity_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in QUERIES["op5_toxicity"](spark, folder).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 50
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9


def test_toxicity_sample_is_bounded_in_rows(spark):
    docs = spark.range(900).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("vile word "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(900).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    machine, index = toxicity.train(docs, labels, sample=50, terms=8)
    assert len(index) <= 8 and np.isfinite(machine.w0)


def test_trigram_scores_follow_the_definition(spark, monkeypatch):
    seen = {}
    fit, shares = lm.fit_weights, lm.fit_shares
    monkeypatch.setattr(lm, "fit_weights", lambda *a: seen.setdefault("w", fit(*a)))
    monkeypatch.setattr(lm, "fit_shares", lambda *a: seen.setdefault("s", shares(*a)))
    monkeypatch.setattr(lm, "BLOCK_CHARS", 300)
    rows = [(i, f"the cat {i % 5} sat on the mat {i % 3}" if i % 7 else "") for i in range(80)]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), order=3).collect()}
    tokens = {i: t.encode().split() for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    pad = lambda ws: [None, None, *ws, 0]
    uni = Counter(w for i in train for w in [*tokens[i], 0])
    bi = Counter(p for i in train for p in zip(pad(tokens[i])[1:], pad(tokens[i])[2:], strict=False))
    tri = Counter(p for i in train for p in zip(pad(tokens[i]), pad(tokens[i])[1:], pad(tokens[i])[2:], strict=False))
    n, v = sum(uni.values()), len(uni)
    uni[None] = bi[None, None] = uni[0]
    level = lambda c: min(math.frexp(c)[1], lm.CONTEXTS - 1)
    for i, ws in tokens.items():
        total = 0.0
        for g, h, w in zip(pad(ws), pad(ws)[1:], pad(ws)[2:], strict=False):
            a, b, c = seen["w"][level(uni[h])]
            low = a / (v + 1) + b * uni[w] / n + (c * bi[h, w] / uni[h] if uni[h] else 0)
            s = seen["s"][level(bi[g, h])]
            total += math.log10((1 - s) * low + (s * tri[g, h, w] / bi[g, h] if bi[g, h] else 0))
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_trigrams_help_and_repeated_rows_are_no_block_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 2000)
    rows = [(None, "the same row again and again")] * 300 + [(i, f"a {i % 3} b {i % 3} c {i % 2} d") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    low, high = ({r.doc_id: r for r in lm.score_documents(df, order=o).collect() if r.doc_id is not None} for o in (2, 3))
    held = [i for i in low if low[i].held_out]
    assert sum(high[i].score for i in held) > sum(low[i].score for i in held)
    assert all(low[i].base_score == pytest.approx(high[i].base_score) and low[i].n_tokens == high[i].n_tokens for i in low)
    assert lm.score_documents(df.limit(0), order=3).count() == 0
