from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
from samples import sentences

from retail_engine.llm.licenses import TEMPLATES, Scanner, aligned, grams, notices, winnowed


def longest_common(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_notices_are_found_whole_with_their_spans(documents):
    rows, want = [], []
    for i, (name, variants) in enumerate(sorted(TEMPLATES.items())):
        head, tail = sentences(i, 40), sentences(100 + i, 40)
        rows.append((i, f"{head}\n# {variants[0]}\n{tail}", "en", "a"))
        want.append((i, name, 1.0))
    rows.append((100, sentences(1, 5000), "en", "a"))
    found = notices(documents(rows)).collect()
    assert sorted((r.key, r.license, r.coverage) for r in found) == sorted(want)
    for r in found:
        words = TEMPLATES[r.license][r.variant].lower().split()
        text = rows[r.key][1].lower()[r.start : r.stop]
        assert text.startswith(words[0]) and words[-1].startswith(text.split()[-1].strip(".,"))


def test_changed_notices_are_aligned():
    scanner, rng = Scanner(), random.Random(1)
    words = TEMPLATES["Apache-2.0"][1].split()
    for _ in range(30):
        text = list(words)
        for _ in range(3):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice([[], ["extra"], ["*", "other", "words"]])
        found = scanner.scan(" ".join([sentences(1, 30), *text, sentences(2, 30)]))
        assert [f[0] for f in found] == ["Apache-2.0"] and found[0][2] >= 0.7


def test_band_alignment_equals_the_full_one_where_the_band_holds_it():
    rng = np.random.default_rng(3)
    for _ in range(50):
        template = rng.integers(1, 40, 30)
        text = [x for x in template.tolist() if rng.random() > 0.1]
        text = np.array(rng.integers(50, 90, 10).tolist() + text + rng.integers(50, 90, 10).tolist())
        matched = aligned(template, text, -10, 20)[0]
        assert matched <= longest_common(template, text) and matched >= longest_common(template, text) - 3


def test_a_shared_run_shares_a_fingerprint():
    rng = np.random.default_rng(4)
    for _ in range(100):
        run = rng.integers(1, 1000, 4)
        a = grams(np.concatenate([rng.integers(1, 1000, 20), run, rng.integers(1, 1000, 20)]))
        b = grams(np.concatenate([rng.integers(1, 1000, 9), run, rng.integers(1, 1000, 30)]))
        assert set(a[winnowed(a)].tolist()) & set(b[winnowed(b)].tolist())


def test_every_repeat_of_a_notice_is_found():
    scanner = Scanner()
    for name, variants in TEMPLATES.items():
        for variant, text in enumerate(variants):
            for n in (2, 1000) if name in ("MIT", "CC0-1.0") else (2,):
                found = scanner.scan("\n".join([sentences(1, 20)] + [text] * n + [sentences(2, 20)]))
                assert [f[:3] for f in found] == [(name, variant, 1.0)] * n
                assert all(a[5] < b[4] for a, b in zip(found, found[1:], strict=False))


def test_repeats_of_changed_notices_are_found():
    scanner = Scanner()
    text = "Licensed under the (well known) Apache License, Version 2.0. "
    found = scanner.scan(sentences(1, 20) + "\n" + text * 100)
    assert [(f[0], f[3]) for f in found] == [("Apache-2.0", 8)] * 100


def test_every_license_line_of_the_given_documents_has_a_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = defaultdict(list)
    for row in notices(docs).collect():
        found[row.key].append(row)
    lines = 0
    for row in docs.collect():
        text = (row.text or "").lower()
        own = [m.span() for m in re.finditer(r"[^\n]*licen[sc]e[^\n]*", text)]
        for a, b in own:
            assert any(a <= r.start and r.stop <= b for r in found[row.doc_id]), text[a:b]
        assert len(found[row.doc_id]) == len(own)
        lines += len(own)
    assert lines == 39
    kinds = {r.license for rows in found.values() for r in rows}
    assert kinds == {"MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"}


def test_creative_commons_forms_are_told_apart():
    scanner = Scanner()
    for code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("4.0", "3.0"):
            for text in TEMPLATES[f"CC-{code}-{version}"]:
                found = scanner.scan(f"{sentences(1, 20)}\n{text}\n{sentences(2, 20)}")
                assert [(f[0], f[2]) for f in found] == [(f"CC-{code}-{version}", 1.0)]


def test_odd_rows(odd, empty):
    assert notices(odd).count() == 0 and notices(empty).count() == 0


def test_spdx_tags_name_their_license():
    scanner = Scanner()
    for name, variants in TEMPLATES.items():
        for end in ("", "\n", " */", "-or-later", "-only\n"):
            text = f"// SPDX-License-Identifier: {name}{end}"
            (own,) = scanner.scan(text)
            assert own[:3] == (name, len(variants), 1.0)
            assert text[own[4] : own[5]] == f"SPDX-License-Identifier: {name}"
    for other in ("Artistic-2.0", "MIT-0", "BSD-3-Clause-Clear", "GPL-1.0", "", "see below. MIT it is"):
        assert scanner.scan(f"# SPDX-License-Identifier: {other}\n") == []


def test_spans_are_those_of_the_given_text():
    text = "İİİİ Licensed under the MIT License. İ SPDX-License-Identifier: Zlib"
    found = [text[n[4] : n[5]] for n in Scanner().scan(text)]
    assert found == ["Licensed under the MIT License", "SPDX-License-Identifier: Zlib"]
