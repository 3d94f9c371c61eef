import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import decontamination, license_scan, packing, quality_model, quality_rules, sharding, toxicity
from sievework.llm.store import stored
from tests.conftest import SMALL, same
from tests.llm.fixtures import documents, pairs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_rules_against_sql(spark, duck):
    assert same(quality_rules.query(spark, SMALL), duck.execute(quality_rules.ORACLE))


def test_rules(spark):
    got = {r["doc_id"]: r for r in quality_rules.build_ledger(documents(spark)).collect()}
    for i, t in pairs_of():
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
    assert len(got) == len(pairs_of())


def test_policies_and_ablation(spark):
    ledger = quality_rules.build_ledger(documents(spark))
    kept = quality_rules.apply_policy(ledger, quality_rules.BASE).where("kept").count()
    table = {r["rule"]: r for r in quality_rules.ablation(ledger, quality_rules.BASE).collect()}
    assert kept < ledger.count() and all(table[r]["n_kept_without"] == kept + table[r]["n_failed_alone"] for r in quality_rules.BASE.rules)
    assert quality_rules.build_ledger(documents(spark, [])).count() == 0


@pytest.mark.parametrize("length", [64, 4096])
def test_packing_round_trip(spark, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    got = [r.asDict() for r in packing.pack(documents(spark).repartition(3), length=length).collect()]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in pairs_of():
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(sequences) == list(range(len(sequences))) and all(v == length for k, v in sequences.items() if k < len(sequences) - 1)


def test_packing_awkward(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    words = ["It's", "don't,'s", "a…,", "é,", "×,", "÷!", "x" * 500, "...", "A1b2", f"{packing.MARK},", packing.MARK, "é.", "«q»,", "naïve-co-op?!"]
    text = " ".join(words) + " end."
    r = packing.pack(documents(spark, [(1, text)])).first()
    ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
    assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert packing.pack(documents(spark, [])).count() == 0
    assert packing.pack(documents(spark, [(7, None), (7, "")])).count() == 2
    mixed = packing.pack(documents(spark, [(None, "no id"), (-1, "one"), (None, ""), (0, "x")]).coalesce(1)).collect()
    assert [r["doc_id"] for r in sorted(mixed, key=lambda r: r["offset"])] == [None, -1, None, 0]


def test_the_training_sample_is_bounded(spark):
    """Labels without a document take no place, and a repeated id gives one row."""
    labels = spark.createDataFrame([(i, 1) for i in range(-50, 0)] + [(1, 1), (1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    docs = documents(spark, [(1, f"copy {i}") for i in range(300)] + [(i, f"text {i}") for i in range(2, 9)] + [(None, "x")])
    rows = quality_model.training_texts(docs, labels, "quality", 1, 5, 3).collect()
    assert len(rows) == 3 and len({r["doc_id"] for r in rows}) == 3 and {r["doc_id"] for r in rows} <= {1, 2, 3, 4}
    assert quality_model.training_texts(docs, labels, "quality", 1, 5, 100).count() == 4


def plain_hits(docs, items):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    split = lambda t: ALNUM.findall((t or "").translate(low))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination(spark, block):
    base = [t for _, t in pairs_of()]
    items = [(1, " ".join(base[0].split()[5:40])), (2, base[1].upper()), (3, "two words"), (4, None), (5, ""), (10, "one"), (9, " ".join(base[0].split()[30:45])), (3, "kilo7 never")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontamination.find(documents(spark), bench, block).collect()))
    assert got == plain_hits(pairs_of(), items)
    left = decontamination.clean(documents(spark), bench, block)
    assert sorted(r["doc_id"] for r in left.collect()) == [r[0] for r in got if not r[5]] and left.columns == documents(spark).columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find(documents(spark), none).where("contaminated").isEmpty()
    assert decontamination.find(documents(spark, []), bench).count() == 0


def test_decontamination_against_sql(spark, duck):
    assert same(decontamination.query(spark, SMALL), duck.execute(decontamination.ORACLE))


def test_sharding(spark):
    slotted = sharding.with_slots(documents(spark)).cache()
    sizes = sharding.slot_sizes(slotted)
    first = sharding.first_map(sizes, 4)
    rows = sharding.place(slotted, first).collect()
    assert len(rows) == len(pairs_of())
    for i, t in pairs_of():
        r = next(r for r in rows if r["doc_id"] == i)
        assert (r["size"], r["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    grown = sharding.grown_map(first, sizes, 4)
    assert {v for v, _, _ in grown} == {2}
    assert all(a[2] == b[2] or b[2] == 4 for a, b in zip(first, grown, strict=True)) and any(b[2] == 4 for b in grown)
    empty = sharding.with_slots(documents(spark, []))
    assert sharding.place(empty, sharding.first_map(sharding.slot_sizes(empty), 4)).count() == 0
    odd = sharding.with_slots(documents(spark, [(None, None), (None, "x"), (1, "x"), (1, "x")]))
    assert sharding.place(odd, sharding.first_map(sharding.slot_sizes(odd), 2)).count() == 4


def test_balance(spark):
    load = Counter()
    for r in sharding.query(spark, SMALL).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.1 * min(load.values()) or max(load.values()) - min(load.values()) < 40000


@pytest.mark.parametrize("module,label,parts,out", [(quality_model, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_models_on_held_out_rows(spark, module, label, parts, out):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = module.query(spark, d).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()
    assert (got["predicted"] == got["y"]).mean() > 0.97
    order = got["score"].rank()
    n1, n0 = (got["y"] == 1).sum(), (got["y"] == 0).sum()
    assert (order[got["y"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.98


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_models_awkward(spark, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (999, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, [*pairs_of(), (None, "x"), (3, "again")])
    got = module.score(docs, module.train(docs, labels)).collect()
    assert len(got) == len(pairs_of()) + 2 and all(0 <= r["score"] <= 1 for r in got)
    none = labels.where("false")
    assert {r["score"] for r in module.score(docs, module.train(docs, none)).select("score").distinct().collect()} == {0.5}
    assert module.score(documents(spark, []), module.train(documents(spark, []), none)).count() == 0


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    f = rng.normal(size=500)
    x, y = toxicity.isotonic(f, (rng.random(500) < 1 / (1 + np.exp(-2 * f))).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and 0 <= y.min() and y.max() <= 1


def test_licences(spark):
    lines = {1: "Released under the MIT License.\nfoo", 2: None, 3: "The driver lost his license.", 4: "Licensed under the Zorro Private License v7.", 5: "Licensed under CC BY-NC 4.0.\nAll rights reserved.", 6: "", 7: "license", 8: "x" * 100000}
    got = {r["doc_id"]: [(x["paragraph"], x["family"], x["confirmed"]) for x in r["licences"]] for r in license_scan.scan(documents(spark, list(lines.items()))).collect()}
    assert got[1] == [(0, "mit", True)] and got[5] == [(0, "cc_by_nc", True), (1, "proprietary", True)]
    assert got[4] == [(0, "unknown", False)] and not any(got[i] for i in (2, 3, 6, 7, 8))
    assert license_scan.scan(documents(spark, [])).count() == 0


def test_every_notice_is_known(spark):
    rows = [(f, n) for f, notes in license_scan.NOTICES.items() for n in notes]
    got = license_scan.scan(documents(spark, [(i, n.capitalize() + ".") for i, (_, n) in enumerate(rows)])).collect()
    right = sum(bool(r["licences"]) and r["licences"][0]["family"] == rows[r["doc_id"]][0] for r in got)
    assert right >= 0.9 * len(rows)


def test_packing_added_tokens():
    """Added tokens are matched in the raw text; texts with one, and those around them, get the tokenizer's own ids."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    texts = ["end <|endoftext|> start", "", "a<|startoftext|>b, c.", "plain text, no marker.", "<|ENDOFTEXT|> x", "x<|EndOfText|>y", "<|endoftext|>", "<|endoftext|><|startoftext|>\n\nend.", "<|endoftext|", "|> last, é."]
    data = [x.encode() for x in texts]
    part = packing.tx.Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    words = packing.WordTokens(packing.default_vocabulary())
    for _ in range(2):  # the second time from the words remembered
        ids, n = words(part)
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [[*t.encode(x, add_special_tokens=False).ids, packing.END] for x in texts]
    assert t.encode(texts[0], add_special_tokens=False).ids == [806, 49407, 1572]


#: Notices that occur nowhere in the training texts, with their family.
UNSEEN = """isc|Permission to use, copy, and distribute this software and its documentation for any purpose and without fee is hereby granted
isc|Source code is available under an ISC-style license: ISC License
isc|Published under the ISC licence, see COPYING
epl|This work is made available under the Eclipse Public License, v 2.0
epl|Eclipse Public License - v 1.0
epl|All files are distributed under EPL-2.0
boost|Use of this header is governed by the Boost Software License, Version 1.0
boost|(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)
boost|The parser is available under the Boost license
eupl|Licensed under the European Union Public Licence, version 1.2
eupl|Distributed under the terms of the EUPL 1.1
eupl|The tool may be used under the EUPL-1.2
mit|-- SPDX-License-Identifier: MIT
apache|; SPDX-License-Identifier: Apache-2.0
gpl|# SPDX-License-Identifier: GPL-3.0-only
lgpl|/* SPDX-License-Identifier: LGPL-2.1-only */
agpl|// SPDX-License-Identifier: AGPL-3.0-only
bsd|* SPDX-License-Identifier: BSD-2-Clause
mpl|<!-- SPDX-License-Identifier: MPL-2.0 -->
isc|% SPDX-License-Identifier: ISC
gpl|It is free software, and may be redistributed under the terms of the GNU General Public License
gpl|the program comes under GPLv3 or later
gpl|This module is distributed under the same licence as the kernel, GPL version 2
lgpl|The library is covered by the GNU Lesser General Public License, version 3
agpl|The server code is covered by the GNU Affero General Public License v3.0
mit|The MIT License
mit|Permission is hereby granted, free of charge, to any person who obtains a copy of the Software
mit|Code by Jane Roe, MIT licensed. Licensed under the MIT License (see LICENSE.md).
apache|Licensed under Apache License v2.0
apache|The samples are offered under the Apache License, Version 2.0, unless noted
bsd|This package is released under the 3-clause BSD license
bsd|Redistributions in binary form must reproduce the above copyright notice in the documentation
mpl|The add-on is covered by the Mozilla Public License, version 2.0
cc0|The author has dedicated this work to the public domain under CC0
cc_by|This chapter is distributed under a Creative Commons Attribution 4.0 International Licence
cc_by_sa|The encyclopedia is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License
cc_by_nc|This book is available under a Creative Commons Attribution-NonCommercial 3.0 license
unlicense|This is free and unencumbered software; it is released into the public domain
zlib|The authors will not be held liable for any damages arising from the use of this software
proprietary|© 2021 Musterfirma. All rights reserved worldwide.
proprietary|Tous droits réservés, reproduction interdite
wtfpl|This program is licensed under the WTFPL, version 2""".split("\n")

#: Prose and notices of other licences: no family may be confirmed.
NO_FAMILY = """The ship was registered under the flag of a free port
MIT has a free public lecture on software in May
The Apache people of Arizona keep their own language
Permission to enter the building is granted by the manager
The rights to the film were sold to another company
Version 2.0 of the library was faster than the first
Licensed under the Kestrel Trading License
Subject to the terms of the Orchid Data Agreement
The general public may use the park without charge
Copies of the report are available at the desk""".split("\n")

WRAPPED = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version."""


def test_unseen_notices(spark):
    rows = [(i, line.split("|", 1)[1]) for i, line in enumerate(UNSEEN)] + [(1000 + i, t) for i, t in enumerate(NO_FAMILY)]
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(documents(spark, rows)).collect()}
    families = [line.split("|")[0] for line in UNSEEN]
    right = [bool(got[i]) and got[i][0]["family"] == f for i, f in enumerate(families)]
    assert sum(right) >= 0.9 * len(right), [UNSEEN[i] for i, ok in enumerate(right) if not ok]
    assert not any(x["confirmed"] for i in range(len(NO_FAMILY)) for x in got[1000 + i])


def test_wrapped_notice(spark):
    rows = [(1, WRAPPED), (2, f"Some prose about the sea.\nMore of it.\n\n{WRAPPED}\n\nint main() {{}}"), (3, WRAPPED.replace("GNU General", "GNU Lesser General")), (4, "Licensed under the\nMIT\nlicense")]
    got = {r["doc_id"]: [(x["paragraph"], x["family"], x["confirmed"]) for x in r["licences"]] for r in license_scan.scan(documents(spark, rows)).collect()}
    assert got == {1: [(0, "gpl", True)], 2: [(3, "gpl", True)], 3: [(0, "lgpl", True)], 4: [(0, "mit", True)]}


def test_scan_is_the_plain_scorer(spark):
    """Every word of every text, awkward ones too, against plain Python."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, (_, t) in enumerate(pairs_of())]
    rows += [(20_000 + i, t) for i, t in enumerate([WRAPPED, "\n".join(x.split("|")[1] for x in UNSEEN), "\n\n".join(x.split("|")[1] for x in UNSEEN), " ".join(NO_FAMILY), "mit " * 9, "license\n\nmit license\n", "Licensed\r\nunder the MIT license.\r\n"])]
    got = license_scan.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        want = license_scan.plain_scan(text[r["doc_id"]])
        assert [(x["paragraph"], x["family"], x["confirmed"]) for x in r["licences"]] == [(p, f, c) for p, f, _, _, c in want]
        assert all(abs(x["probability"] - p) < 2e-6 and abs(x["overlap"] - o) < 2e-6 for x, (_, _, p, o, _) in zip(r["licences"], want, strict=True))


def test_slot_map_is_a_versioned_table(spark, tmp_path):
    path = str(tmp_path / "map")
    slotted = stored(sharding.with_slots(documents(spark)), "test-slots")
    sizes = sharding.slot_sizes(slotted)
    first = sharding.first_map(sizes, 4)
    sharding.write_map(spark, first, path)
    assert len(first) == sharding.SLOTS and sharding.read_map(spark, path) == first
    with pytest.raises(Exception, match="already exists"):
        sharding.write_map(spark, first, path)
    grown = sharding.rebalance(spark, path, sizes, 4)
    assert sharding.read_map(spark, path) == grown and sharding.read_map(spark, path, 1) == first and {v for v, _, _ in grown} == {2}
    moved = {b[1] for a, b in zip(first, grown, strict=True) if a[2] != b[2]}
    shards = lambda m: {r["doc_id"]: (r["vslot"], r["shard"]) for r in sharding.place(slotted, m).collect()}
    before, after = shards(first), shards(grown)
    assert moved and all(after[d][1] == (4 if slot in moved else shard) for d, (slot, shard) in before.items())
    # rows that come later, of slots that were empty then, have a shard too
    late = documents(spark, [(i, f"late {i}") for i in range(5000, 5400)])
    assert sharding.place(stored(sharding.with_slots(late), "test-slots"), grown).count() == 400
    with pytest.raises(Exception, match="no shard for slot"):
        sharding.place(slotted, first[: sharding.SLOTS // 2]).collect()


def test_hot_slot_is_numbered_in_parts(spark):
    docs = documents(spark, [(None if i % 3 else i, f"t{i}") for i in range(900)])
    slotted = stored(sharding.with_slots(docs), "test-slots")
    rows = sharding.place(slotted, sharding.first_map(sharding.slot_sizes(slotted), 3), part=50).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len(rows) == 900
    spread = sharding.with_slots(docs, by=("doc_id", "text")).groupBy("vslot").count().agg(F.max("count")).first()[0]
    assert spread < 10


def test_shards_have_equal_bytes(spark):
    load = Counter()
    for r in sharding.query(spark, "/root/testdata/sf0.01").collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 8 and max(load.values()) <= 1.001 * min(load.values())


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontamination_of_rows(spark, most):
    """Items without an id, documents of one id, and null ones, by broadcast and by shuffle."""
    base = pairs_of()[0][1].split()
    items = [(None, " ".join(base[3:25])), (None, "lonely word"), (7, " ".join(base[20:40])), (8, "unseen " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, " ".join(base)), (1, "nothing here"), (None, " ".join(base[:15])), (1, None), (2, "a LONELY, word."), (3, " ".join(base[20:40]))]
    got = sorted(map(tuple, decontamination.find(documents(spark, docs), bench, most).collect()), key=str)

    def name(items_of):
        return hashlib.sha256(",".join(sorted(str(i) for i in items_of if i is not None)).encode()).hexdigest()

    assert got == sorted(
        [(1, len(base), 37, 2, name([None, 7]), True), (1, 2, 0, 0, name([]), False), (None, 15, 12, 1, name([]), True), (1, 0, 0, 0, name([]), False), (2, 3, 2, 1, name([]), True), (3, 20, 20, 1, name([7]), True)], key=str
    )
    left = decontamination.clean(documents(spark, docs), bench, most)
    assert sorted((r["doc_id"], r["text"]) for r in left.collect() if r["text"]) == [(1, "nothing here")] and left.count() == 2


def test_decontamination_by_shuffle_against_sql(spark, duck):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontamination.find(docs, bench, 0)
    assert same(out, duck.execute(decontamination.ORACLE))


def test_pipeline_at_its_threshold(spark):
    """All stages against plain versions, near duplicates linked from 0.8 on."""
    import corpus_pipeline

    from tests.llm.test_dedup import plain_cleaned

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.query(spark, SMALL).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect())
    want = [[r for r in rows if not scored[r[0]]]]
    want.append([r for r in want[-1] if r[0] in plain_representatives(want[-1], 80)])
    want.append(plain_cleaned(want[-1]))
    leaks = {r[0] for r in plain_hits(want[-1], items) if r[5]}
    want.append([r for r in want[-1] if r[0] not in leaks])
    docs = table
    for (_, stage), kept in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stored(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == table.columns and sorted((r["doc_id"], r["text"]) for r in docs.collect()) == kept
    pieces = sorted(map(tuple, packing.pack(docs).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == pieces and {p[0] for p in pieces} == {r[0] for r in want[-1]}


def plain_representatives(rows, threshold):
    """The smallest ids of the classes of near-duplicates, by comparing all pairs."""
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids, smallest = sorted(sets), {i: i for i in sets}
    changed = True
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(smallest[a], smallest[b])
            if smallest[a] != m or smallest[b] != m:
                smallest[a] = smallest[b] = m
                changed = True
    return {i for i in ids if smallest[i] == i}


def test_remembered_words_take_few_bytes():
    """A dictionary of Python's numbers took over 100 bytes a word."""
    import tracemalloc

    words = packing.WordTokens(packing.default_vocabulary())
    text = lambda a, b: packing.tx.Texts(np.frombuffer(b := " ".join(f"w{i}" for i in range(a, b)).encode(), np.uint8), np.array([0, len(b)]))
    first = words(text(0, 100_000))[0].tolist()
    words.clear()
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for a in range(0, 100_000, 10_000):
            words(text(a, a + 10_000))
        size = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert size < 5_000_000 and len(words.start) == 100_000
    assert words(text(0, 100_000))[0].tolist() == first and len(words.start) == 100_000
