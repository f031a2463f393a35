import random
import re

from joinwright.llm.licenses import BASE, SENTENCES, license_report, scan_licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEXTS = [
    None, "", "...", "Released under the MIT License.", "mit license mit license MIT  licence", "cc by cc-by cc by-nc", "GNU\nGeneral, Public License version 3",
    "apache license" * 2, "the apache licenses and apache-license!", "mit der license", "É mit licenseé", "mit licen\u212ae mit\u00a0license", "public general gnu license " * 5,
    "Licensed under the Apache License, Version 2.0.", "word " * 30_000 + "cc by", "gnu lesser general public license", "license by mit license by cc by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Redistribution and use in source or binary forms, with or without modification, are permitted",
    "Redistribution and use, in source and binary forms, with or without any modification, are hereby permitted provided that these conditions are met",
    "Permission is hereby granted, free of cost, to any person obtaining a copy of this software and associated files", "Permission is hereby granted, free of charge, to absolutely anybody obtaining a copy of this software and its associated documentation files",
    "a person obtaining software granted permission; hereby a copy of the documentation, files associated, charge free",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_base_places_against_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "", 2), (None, TEXTS[4], "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, id int")
    found = license_report(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        text = TEXTS[4] if r.id is None else TEXTS[r.id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    said = {r.id: r.labels.split(",") for r in found}
    assert "gpl-3.0" in said[6] and "apache-2.0" in said[13] and "lgpl" in said[15] and "mit-text" in said[17]
    assert "bsd" in said[19] and said[9] == [""] and said[18] == [""]
    assert "mit-text" in said[20] and "mit-text" in said[21] and said[22] == [""]


def test_empty_table_and_templates(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert license_report(docs).count() == 0
    assert {t.words: t.label for t in BASE} == PHRASES


def altered(words, draw):
    """One word in ten replaced, dropped or followed by another, outside the key phrases."""
    out, t = [], words.words.split()
    held = {i + j for key in words.keys for k in [key.split()] for i in range(len(t)) if t[i : i + len(k)] == k for j in range(len(k))}
    for i, w in enumerate(t):
        turn = draw.random() if i not in held and i + 1 not in held else 1.0
        out += [] if turn < 0.03 else ["quite"] if turn < 0.06 else [w, "indeed"] if turn < 0.1 and i not in held else [w]
    return out


def test_altered_sentences_are_found_and_torn_ones_are_not(spark):
    draw = random.Random(5)
    noise = "river stone cloud paper table software notice copy use source code the and of to any".split()
    rows, want = [], {}
    for k in range(200):
        t = SENTENCES[k % len(SENTENCES)]
        body = altered(t, draw)
        if k % 4 == 3:  # the words of the sentence in another order
            draw.shuffle(body)
        around = [draw.choice(noise) for _ in range(draw.randrange(80))]
        cut = draw.randrange(len(around) + 1)
        rows.append((k, " ".join(around[:cut] + body + around[cut:])))
        want[k] = t.label if k % 4 != 3 else None
    found = {r.id: {p.label for p in r.places} for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = [want[k] in found[k] for k in found if want[k]]
    false = [bool(found[k]) for k in found if not want[k]]
    assert sum(caught) >= 0.95 * len(caught) and sum(false) <= 0.1 * len(false), (sum(caught), len(caught), sum(false))


def test_each_place_is_listed_once(spark):
    line = SENTENCES[0].words
    rows = [(0, f"{line}. some words stand between these two lines here. {line}"), (1, "mit license " * 3000)]
    found = {r.id: r.places for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(p.label, p.start, p.score) for p in found[0]] == [("mit-text", 0, 1.0), ("mit-text", len(line.split()) + 8, 1.0)]
    assert [p.start for p in found[1]] == list(range(0, 6000, 2))
