"""License scans: fixed phrases, and a positional index of rare licence words."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, ascii_lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# fixed values: phrases and labels of the base rule
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: opening sentences of public licences and a phrase each must hold
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge"),
    "apache-2.0": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    "cc-by": ("this work is licensed under a creative commons attribution international license", "creative commons attribution"),
}
# fixed values: short notices and names, each with its label and the phrase it must hold
NAMES = {
    "mit": ["mit license"],
    "apache-2.0": ["apache license version 2 0", "apache license 2 0"],
    "bsd": ["bsd license", "bsd 2 clause license", "bsd 3 clause license", "2 clause bsd license", "3 clause bsd license"],
    "mpl-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0"],
    "gpl": ["gnu general public license", "gnu gpl"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"],
    "agpl": ["gnu affero general public license", "gnu agpl"],
    "isc": ["isc license"],
    "epl-2.0": ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0"],
    "unlicense": ["the unlicense"],
    "cc0-1.0": ["cc0 1 0", "cc0 1 0 universal"],
    "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives"],
}
SPDX = {"mit": ["mit"], "apache-2.0": ["apache 2 0"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "mpl-2.0": ["mpl 2 0"], "gpl": ["gpl 2 0", "gpl 3 0"], "lgpl": ["lgpl 2 1", "lgpl 3 0"], "agpl": ["agpl 3 0"], "isc": ["isc"], "epl-2.0": ["epl 2 0"], "unlicense": ["unlicense"], "cc0-1.0": ["cc0 1 0"]}
OPENINGS = [
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "affero general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
]
FORMS = [(k, t, p) for k, (t, p) in TEMPLATES.items()] + OPENINGS
FORMS += [(k, n, n) for k, ns in NAMES.items() for n in ns] + [(k, f"spdx license identifier {n}", f"identifier {n}") for k, ns in SPDX.items() for n in ns]
LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def word_counts(docs: DataFrame) -> dict[str, int]:
    """In how many rows each word of the templates stands, over all rows; the vocabulary is that of the templates."""
    vocab = sorted({w for _, t, _ in FORMS for w in t.split()})
    ws = F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), WORD.pattern.replace("[^", "["))
    hit = F.array_intersect(ws, F.array(*[F.lit(w) for w in vocab]))
    return {r["w"]: r["n"] for r in docs.select(F.explode(hit).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def license_table(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, n_words, places of the base phrases, labels and score of each whole text.

    The rarest words of each template, by document frequency in docs, look up its places: as many of them as
    cannot all be missing where the share `least` of its words stands, so that no place is lost. Each place
    with the key phrase is scored by the share of the template's words that stand there. A template is an
    opening sentence, a short notice or a name, each of its own length. A label needs its key phrase within
    that place. Null text is empty and gets no label; the best score counts; repeated rows give repeated
    results; an empty table gives none.
    """
    df = word_counts(docs)
    templates, where = [], set()
    for lab, t, p in FORMS:
        tw, key = t.split(), p.split()
        need = next(k for k in range(len(tw) + 1) if k / len(tw) >= least)
        rare = sorted(range(len(tw)), key=lambda j: (df.get(tw[j], 0), tw[j], j))[: len(tw) - need + 1]
        templates.append((lab, tw, key, rare))
        where.update(tw)
    base = [(p.split(), lab) for p, lab in PHRASES.items()]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                ws = WORD.findall(t.translate(LOWER)) if isinstance(t, str) else []
                at = defaultdict(list)
                for i, w in enumerate(ws):
                    if w in where or w in ("cc", "by", "all", "rights", "reserved"):
                        at[w].append(i)
                places = [(i, lab) for p, lab in base for i in at.get(p[0], ()) if ws[i : i + len(p)] == p]
                keys: dict[tuple, list[int]] = {}
                score, own = 0.0, set()
                for lab, tw, key, rare in templates:
                    if (k := tuple(key)) not in keys:
                        keys[k] = [i for i in at.get(key[0], ()) if ws[i : i + len(key)] == key]
                    if not keys[k]:
                        continue
                    for off in {i - j for j in rare for i in at.get(tw[j], ())}:
                        start = max(0, off)
                        n = bisect_left(keys[k], start)
                        if n < len(keys[k]) and keys[k][n] <= start + len(tw):
                            s = sum(0 <= off + j < len(ws) and ws[off + j] == w for j, w in enumerate(tw)) / len(tw)
                            if s >= least:
                                own.add(lab)
                                score = max(score, s)
                labels = {lab for _, lab in places}
                first = [i for i, _ in places]
                rows.append((len(ws), len(places), min(first) if first else None, max(first) if first else None, ",".join(sorted(labels)), ",".join(sorted(labels | own)), score))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
