"""License scans: an exact set-similarity join of text blocks with license templates, with DataFrame functions only.

Blocks follow the words and not the lines: for templates of one width class (a power of two W that holds the template and a
quarter more) the blocks of a text are the runs of 2 W words that start at every W-th word, so that every run of W words,
wrapped or not, lies whole in a block. A block matches a template if it holds at least the threshold's share of the template's
distinct words (all of them where the template is short) and none of the words that tell a sister license apart. Words
are put in one global order, rarest in all documents first. A pair that meets the threshold shares a word among the
first words of both (prefix filter); length and positional filters cut candidates before the exact count.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import written

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Template(NamedTuple):
    """A notice; a block that holds a word of `without` is another license's."""

    label: str
    notice: str
    without: str = ""


#: Notices of public licenses.
TEMPLATES = (
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "noncommercial nc sharealike sa noderivatives noderivs nd"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", "sa nd"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "sharealike sa noderivatives noderivs nd"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", "lesser affero library"),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "lesser affero library"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mit", "Released under the MIT License"),
    Template("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit-grant", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Share of a template's distinct words that a block must hold; templates of fewer distinct words than SHORT need all, in their order.
CONTAINMENT, SHORT = 0.8, 16
#: Bound of what is broadcast: distinct words of all templates together.
MOST_TEMPLATE_WORDS = 20_000


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def needed(size: int, threshold: float = CONTAINMENT, short: int = SHORT) -> int:
    """How many of a template's `size` distinct words a block must hold."""
    return size if size < short else math.ceil(threshold * size - 1e-9)


def width(template: Template) -> int:
    """The width class: a power of two that is 8 or more and a quarter more than the words of the notice."""
    return 1 << max(3, math.ceil(math.log2(1.25 * len(words_of(template.notice)))))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _pairs_of_spaces(text: Column) -> Column:
    """How many double spaces, of which none overlap, the text has."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit("  "), F.lit("")))) / 2)


def phrase_places(spaced: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(places, first start, last start) of a phrase among words set between double spaces; starts count words."""
    wanted = " " + "  ".join(words_of(phrase)) + " "
    has = F.contains(spaced, F.lit(wanted))
    places = F.when(has, (F.length(spaced) - F.length(F.replace(spaced, F.lit(wanted), F.lit("")))) / len(wanted)).otherwise(0).cast("long")
    first = F.when(has, _pairs_of_spaces(F.substring_index(spaced, wanted, 1)))
    behind = F.length(spaced) - F.length(F.substring_index(spaced, wanted, -1)) - len(wanted)
    last = F.when(has, _pairs_of_spaces(F.left(spaced, behind)))
    return places, first, last


def template_index(templates: Sequence[Template], threshold: float, short: int, order: dict[str, int]) -> list[tuple]:
    """(word, width, place, template, label, size, need, words, without, notice) for the prefix words of each template in the global order."""
    rows = []
    for number, t in enumerate(templates):
        words = sorted(set(words_of(t.notice)), key=lambda w: (order.get(w, 0), w))
        need = needed(len(words), threshold, short)
        rows += [(w, width(t), k, number, t.label, len(words), need, words, words_of(t.without), words_of(t.notice)) for k, w in enumerate(words[: len(words) - need + 1])]
    return rows


def matches(held: DataFrame, templates: Sequence[Template], threshold: float, short: int) -> DataFrame:
    """(rid, width, block, template, label, share): blocks of the texts that match a template. held: (rid, held array of (at, word)), with
    the words of the templates in each text and their places."""
    counts = held.select(F.explode(F.array_distinct(F.col("held.word"))).alias("word")).groupBy("word").count()
    order = {r["word"]: r["count"] for r in counts.collect()}  # words of the templates only
    rows = template_index(templates, threshold, short, order)
    index = held.sparkSession.createDataFrame(rows, "word string, width int, t_place int, template int, label string, t_size int, need int, t_words array<string>, without array<string>, notice array<string>")
    ordered = sorted({w for t in templates for w in words_of(t.notice)}, key=lambda w: (order.get(w, 0), w))
    heads = sorted({r[0] for r in rows})
    least = {w: min(r[6] for r in rows if r[1] == w) for w in sorted({r[1] for r in rows})}
    # a text without any prefix word matches nothing
    some = held.where(F.exists("held", lambda x: x["word"].isin(heads))).select("rid", F.explode("held").alias("x"))
    starts = F.array(*[F.struct(F.lit(w).alias("width"), (F.floor(F.col("x.at") / w) - back).alias("block")) for w in least for back in (0, 1)])
    blocks = some.select("rid", "x.word", F.explode(starts).alias("b")).where("b.block >= 0").groupBy("rid", F.col("b.width").alias("width"), F.col("b.block").alias("block")).agg(F.collect_set("word").alias("all"))
    blocks = blocks.withColumn("held", F.array_intersect(F.array(*map(F.lit, ordered)), "all")).withColumn("n", F.size("held"))
    blocks = blocks.withColumn("least", F.coalesce(*[F.when(F.col("width") == w, F.lit(n)) for w, n in least.items()])).where(F.col("n") >= F.col("least"))
    prefix = blocks.select("rid", "width", "block", "all", "held", "n", F.posexplode(F.slice("held", F.lit(1), F.col("n") - F.col("least") + 1)).alias("place", "word"))
    close = (F.col("n") >= F.col("need")) & (F.col("place") <= F.col("n") - F.col("need")) & (F.lit(1) + F.least(F.col("n") - F.col("place"), F.col("t_size") - F.col("t_place")) - 1 >= F.col("need"))
    pairs = prefix.join(F.broadcast(index), ["word", "width"]).where(close).withColumn("shared", F.size(F.array_intersect("held", "t_words")))
    pairs = pairs.where((F.col("shared") >= F.col("need")) & (F.size(F.array_intersect("all", "without")) == 0))
    found = pairs.select("rid", "width", "block", "template", "label", (F.col("shared") / F.col("t_size")).alias("share"), (F.col("t_size") < short).alias("brief"), "notice").distinct()
    # a short notice's words are common ones: they must stand in their order
    inside = F.filter("held", lambda x: x["at"].between(F.col("block") * F.col("width"), (F.col("block") + 2) * F.col("width") - 1))
    in_order = F.aggregate(inside, F.lit(0), lambda k, x: F.when(x["word"] == F.get("notice", k), k + 1).otherwise(k)) == F.size("notice")
    placed = found.where("brief").join(held, "rid").where(in_order).select(*found.columns)
    return found.where(~F.col("brief")).unionByName(placed).select("rid", "width", "block", "template", "label", "share")


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[Template] = TEMPLATES, threshold: float = CONTAINMENT, short: int = SHORT) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    base_* come from the phrases; labels adds those of templates that some block (see above) matches. n_blocks counts pairs
    of such a block and a template; score is the largest containment, 1 where a phrase stands. A null or empty text has no
    word, no label (empty strings), null places and score 0; repeated rows stay repeated; an empty table gives no rows; other
    columns are ignored. The largest thing broadcast is the templates' words, whose number is checked.
    """
    vocabulary = sorted({w for t in templates for w in words_of(f"{t.notice} {t.without}")})
    if len(vocabulary) > MOST_TEMPLATE_WORDS or not 0 < threshold <= 1:
        raise ValueError("templates over the bound, or a threshold outside 0..1")
    # each word stands between double spaces; a text without a word is two spaces
    spaced = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.regexp_replace(F.concat(F.lit(" "), lowered(F.col("text")), F.lit(" ")), BETWEEN, "  ").alias("whole"))
    found = [phrase_places(F.col("whole"), p) for p in phrases]
    base = F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(n > 0, F.lit(label)) for (n, _, _), label in zip(found, phrases.values(), strict=True)]), lambda x: x.isNotNull()))), ",")
    nothing = F.lit(None).cast("long")
    held = F.filter(F.transform(F.split(F.trim("whole"), "  "), lambda w, at: F.struct(at.alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary))
    facts = spaced.select(
        "rid", "doc_id", (_pairs_of_spaces(F.col("whole")) - 1).cast("long").alias("n_words"),
        sum((n for n, _, _ in found), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[f for _, f, _ in found], nothing).cast("long").alias("first_word"), F.greatest(*[x for _, _, x in found], nothing).cast("long").alias("last_word"),
        base.alias("base_labels"), held.alias("held"),
    )
    facts = written(facts, "blocks")
    matched = matches(facts.select("rid", "held"), templates, threshold, short).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.count(F.lit(1)).alias("n_blocks"))
    facts = facts.drop("held").join(matched, "rid", "left")
    every = F.array_union(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.coalesce("more", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return facts.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(F.array_sort(every), ",").alias("labels"), score.alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))
