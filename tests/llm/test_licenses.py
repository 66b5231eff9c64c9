from __future__ import annotations

import re

from haulcast.llm import licenses
from haulcast.llm.license_texts import NOTICES, PHRASES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def phrase_places(text):
    w = words(text)
    return sorted(
        (k, label) for label, p in PHRASES for q in [words(p)] for k in range(len(w)) if w[k : k + len(q)] == q
    )


def scan(df):
    return {r.doc_id: r for r in licenses.scan_licenses(df).collect()}


def test_phrases_wherever_they_stand(docs, real):
    extra = [
        (10001, "under the MIT license under the mit license"),
        (10002, "Apache-License, version/2; CC BY-NC 4.0 under the mit licenses"),
        (10003, "cc by nc cc by nc by cc by nc"),
    ]
    rows = [*real, *extra]
    out = scan(docs(rows))
    for i, text in rows:
        assert sorted((s.first, s.label) for s in out[i].phrases) == phrase_places(text)
        assert out[i].n_words == len(words(text))


def test_every_notice_is_found_whole_and_edited(docs):
    noise = "some words before the text and "
    rows = []
    for i, (_, text) in enumerate(NOTICES):
        w = words(text)
        rows.append((2 * i, noise + text.upper() + " and after it"))
        rows.append((2 * i + 1, noise + " ".join([*w[: len(w) // 2], "added", *w[len(w) // 2 :]])))
    out = scan(docs(rows))
    for i, (label, text) in enumerate(NOTICES):
        whole = [s for s in out[2 * i].notices if s.label == label and s.score == 1.0]
        assert whole and whole[0].first == len(words(noise))
        if len(words(text)) > 12:
            assert [s.label for s in out[2 * i + 1].notices] == [label]
            assert 0.8 <= out[2 * i + 1].notices[0].score < 1


def test_nothing_where_nothing_is(docs):
    rows = [(1, None), (2, ""), (3, "permission to use the license of this software"), (4, "mit apache cc by"), (None, "x")]
    out = licenses.scan_licenses(docs(rows)).collect()
    assert len(out) == 5 and all(not r.phrases and not r.notices for r in out)


def test_repeated_rows(docs):
    rows = [(1, "under the mit license"), (1, "under the mit license"), (1, "other"), (None, "cc by nc"), (None, "cc by nc")]
    out = licenses.scan_licenses(docs(rows)).collect()
    assert sorted(len(r.phrases) for r in out) == [0, 1, 1, 1, 1]


def test_longest_chain():
    assert licenses.longest_chain([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
