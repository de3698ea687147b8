"""License scan by ordered signature rules (operator 6).

A text is turned into its lower-cased words, joined by single spaces. Rules are regular
expressions over that, each with a label, a priority (1 first) and gates: words
of which every match has one at least. Only rules with a gate among a document's words
are tried. Each match is an interval of words. A match inside the
interval of another rule's match of the same or a better priority is suppressed (of equal
intervals, the one of the better priority, then of the earlier rule, stays), found in one pass over a
document's matches in order of their starts. Base phrases are rules as well; their places and labels
are reported whatever suppresses them.

Rules are built from ``FAMILIES`` (one hand-written name pattern a line) in ``FORMS``
(how a notice, a tag, a version and a mention are put), and from ``NOTICES`` (hand-written passages of license texts, addresses and references). All steps are DataFrame operations.

Cases. A null or empty text has no words, no labels and score 0. Repeated rows each give a row with the same
result. A document of many thousand matches is handled row by row, not as an array. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .joins import match
from .native_words import count_words, words

#: The phrases that count as base, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label | gates | pattern of the name | tag, in words; "-" for none.
FAMILIES = """
mit | mit | mit(?: x11)? licen[cs]e | mit
mit | expat | expat licen[cs]e | -
mit | permission | permission is hereby granted free of charge to any person obtaining a copy | -
mit-0 | mit | mit no attribution(?: licen[cs]e)? | mit 0
apache | apache | apache (?:software )?licen[cs]e | apache 2 0
apache | apache | apache (?:license )?(?:version )?2(?: 0)? | apache 1 1
asl | asl | asl 2(?: 0)? | -
gpl | gpl gplv0 gplv1 gplv2 gplv3 gplv4 gplv5 gplv6 gplv7 gplv8 gplv9 | (?:gnu )?gpl(?:v[0-9])? | gpl 3 0 (?:only|or later)
gpl | gnu | gnu general public licen[cs]e | gpl 2 0 (?:only|or later)
lgpl | lgpl lgplv0 lgplv1 lgplv2 lgplv3 lgplv4 lgplv5 lgplv6 lgplv7 lgplv8 lgplv9 | (?:gnu )?lgpl(?:v[0-9])? | lgpl 3 0 (?:only|or later)
lgpl | lesser | (?:gnu )?lesser general public licen[cs]e | lgpl 2 1 (?:only|or later)
lgpl | library | gnu library general public licen[cs]e | lgpl 2 0 (?:only|or later)
agpl | agpl agplv3 | (?:gnu )?agpl(?:v3)? | agpl 3 0 (?:only|or later)
agpl | affero | (?:gnu )?affero general public licen[cs]e | agpl 3 0
gfdl | gfdl | (?:gnu )?gfdl | gfdl 1 3
gfdl | documentation | (?:gnu )?free documentation licen[cs]e | gfdl 1 2
bsd | bsd | (?:new |modified |simplified |revised |original )?bsd(?: style)? licen[cs]e | -
bsd-2 | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)? | bsd 2 clause
bsd-3 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)? | bsd 3 clause(?: clear)?
bsd-4 | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)? | bsd 4 clause
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted | -
0bsd | 0bsd zero | (?:zero clause bsd|0bsd)(?: licen[cs]e)? | 0bsd
isc | isc | isc licen[cs]e | isc
mpl | mpl | mpl(?: v?[12](?: [01])?)? | mpl 2 0
mpl | mozilla | mozilla public licen[cs]e | mpl 1 1
epl | eclipse | eclipse public licen[cs]e | epl 2 0
edl | eclipse | eclipse distribution licen[cs]e | -
cddl | cddl | cddl(?: 1 [01])? | cddl 1 0
cddl | distribution | common development and distribution licen[cs]e | cddl 1 1
cpl | common | common public licen[cs]e | cpl 1 0
cpal | attribution | common public attribution licen[cs]e | cpal 1 0
eupl | eupl | eupl(?: v?1 [12])? | eupl 1 2
eupl | european | european union public licen[cs]e | eupl 1 1
artistic | artistic | artistic licen[cs]e | artistic 2 0
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib
libpng | libpng | libpng licen[cs]e | libpng
boost | boost | boost software licen[cs]e | bsl 1 0
unlicense | unlicense | (?:the )?unlicense | unlicense
unlicense | unencumbered | this is free and unencumbered software released into the public domain | -
wtfpl | wtfpl | wtfpl | wtfpl
cc0 | cc0 | cc0(?: 1 0)?(?: universal)? | cc0 1 0
cc0 | zero | creative commons zero | -
cc-by | cc | cc by(?! (?:nc|nd|sa)\\b) | cc by 4 0
cc-by-sa | cc | cc by sa | cc by sa 4 0
cc-by-nc | cc | cc by nc(?! (?:nd|sa)\\b) | cc by nc 4 0
cc-by-nc-sa | cc | cc by nc sa | cc by nc sa 4 0
cc-by-nc-nd | cc | cc by nc nd | cc by nc nd 4 0
cc-by-nd | cc | cc by nd | cc by nd 4 0
cc-by | creative | creative commons attribution(?! (?:non|no|share)) | -
cc-by-sa | creative | creative commons attribution share ?alike | -
cc-by-nc | creative | creative commons attribution non ?commercial(?! (?:no|share)) | -
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike | -
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s? | -
cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s? | -
cc | creative | creative commons licen[cs]e | -
ofl | ofl | (?:sil )?ofl(?: 1 1)? | ofl 1 1
ofl | font | (?:sil )?open font licen[cs]e | ofl 1 0
psf | python | python software foundation licen[cs]e | psf 2 0
psf | python | python licen[cs]e | python 2 0
postgresql | postgresql | postgresql licen[cs]e | postgresql
openssl | openssl | openssl licen[cs]e | openssl
php | php | php licen[cs]e | php 3 01
ruby | ruby | ruby licen[cs]e | ruby
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e | ncsa
ms-pl | microsoft | microsoft public licen[cs]e | ms pl
ms-rl | microsoft | microsoft reciprocal licen[cs]e | ms rl
osl | open | open software licen[cs]e | osl 3 0
afl | academic | academic free licen[cs]e | afl 3 0
ecl | educational | educational community licen[cs]e | ecl 2 0
upl | universal | universal permissive licen[cs]e | upl 1 0
beerware | beerware | beerware licen[cs]e | beerware
json | json | json licen[cs]e | json
vim | vim | vim licen[cs]e | vim
w3c | w3c | w3c (?:software )?(?:notice and )?licen[cs]e | w3c
x11 | x11 | x11 licen[cs]e | x11
curl | curl | curl licen[cs]e | curl
imagemagick | imagemagick | imagemagick licen[cs]e | imagemagick
ipl | ibm | ibm public licen[cs]e | ipl 1 0
qpl | qpl q | (?:q public licen[cs]e|qpl) | qpl 1 0
sleepycat | sleepycat | sleepycat licen[cs]e | sleepycat
zend | zend | zend (?:engine )?licen[cs]e | zend 2 0
zpl | zope | zope public licen[cs]e | zpl 2 1
odbl | odbl | odbl | odbl 1 0
odbl | database | open database licen[cs]e | -
odc-by | odc | (?:odc by|odc attribution licen[cs]e) | odc by 1 0
pddl | dedication | public domain dedication and licen[cs]e | pddl 1 0
apsl | apple | apple public source licen[cs]e | apsl 2 0
cecill | cecill | cecill(?: [abc])?(?: licen[cs]e)? | cecill 2 1
sspl | sspl | sspl | sspl 1 0
sspl | server | server side public licen[cs]e | -
busl | business | business source licen[cs]e | busl 1 1
elastic | elastic | elastic licen[cs]e | elastic 2 0
commons-clause | clause | commons clause | -
mulan | mulan | mulan (?:permissive software licen[cs]e|psl) | mulanpsl 2 0
nasa | nasa | nasa open source agreement | nasa 1 3
hpnd | historical | historical permission notice and disclaimer | hpnd
icu | icu | icu licen[cs]e | icu
unicode | unicode | unicode licen[cs]e | unicode 3 0
openrail | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)? | -
public-domain | public | (?:released into|dedicated to|placed in|in) the public domain | -
proprietary | reserved | all rights reserved | -
proprietary | confidential | proprietary and confidential | -
"""

#: label | gates | pattern: headers, grants and disclaimers of license texts, addresses of licenses, references to a license file.
NOTICES = """
gpl | redistribute | you can redistribute it and or modify it under the terms of (?:version [23] of )?the gnu general public licen[cs]e
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
agpl | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
gpl | gnu | you should have received a copy of the gnu general public licen[cs]e along with this
lgpl | gnu | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this
agpl | gnu | you should have received a copy of the gnu affero general public licen[cs]e along with this
gfdl | gnu | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
apache | compliance | you may not use this file except in compliance with the licen[cs]e
apache | specific | see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e
mpl | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e
mpl | incompatible | this source code form is incompatible with secondary licen[cs]es
epl | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | warranty | the software is provided as is without warranty of any kind express or implied
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | contributors | this software is provided by the copyright holders and contributors as is
bsd-3 | endorse | neither the name of (?:the )?(?:copyright holder|author|company|organi[sz]ation) nor the names of its contributors may be used to endorse or promote products
bsd-4 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2 | redistributions | redistributions in binary form must reproduce the above copyright notice
zlib | misrepresented | the origin of this software must not be misrepresented
boost | obtaining | permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation
wtfpl | do | do what the fuck you want to public licen[cs]e
ofl | font | this font software is licensed under the sil open font licen[cs]e
cc | creative | this work is licen[cs]ed under a creative commons
cc0 | waived | has waived all copyright and related or neighbou?ring rights
artistic | artistic | under the same terms as perl itself or the artistic licen[cs]e
apache | apache | apache org licenses(?: license 2 0)?
gpl | gnu | gnu org licenses gpl(?: [23] 0)?
lgpl | gnu | gnu org licenses lgpl(?: [23] [01])?
agpl | gnu | gnu org licenses agpl(?: 3 0)?
gfdl | gnu | gnu org licenses fdl(?: 1 [123])?
mit | opensource | opensource org licen[cs]es? mit
bsd | opensource | opensource org licen[cs]es? bsd(?: [234] clause)?
mpl | mozilla | mozilla org mpl(?: 2 0)?
epl | eclipse | eclipse org legal epl(?: v[12]0| 2 0)?
cc-by | creativecommons | creativecommons org licenses by [1234] 0
cc-by-sa | creativecommons | creativecommons org licenses by sa [1234] 0
cc-by-nc | creativecommons | creativecommons org licenses by nc [1234] 0
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1234] 0
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1234] 0
cc-by-nd | creativecommons | creativecommons org licenses by nd [1234] 0
cc0 | creativecommons | creativecommons org publicdomain zero 1 0
unlicense | unlicense | unlicense org
boost | boost | boost org license 1 0
proprietary | unauthori[sz]ed | unauthori[sz]ed copying of this file
proprietary | trade | contains trade secrets and confidential information
reference | see | see (?:the )?(?:file )?licen[cs]e(?: txt| md| file)? (?:for|in the project root for) (?:more |full |licen[cs]e )?(?:details|information|terms)
reference | found | licen[cs]e that can be found in the licen[cs]e file
reference | copying | see (?:the )?(?:file )?copying(?: txt)? for (?:more )?(?:details|information)
"""

#: How a name is put: priority, confidence, and what stands around it.
FORMS = (
    (1, 0.95, r"(?:licen[cs]ed|released|distributed|available|provided|published|redistributed|covered|governed|shared|offered) (?:under|by|subject to) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?{name}(?: (?:version |v)?[0-9]+(?: [0-9]+)*)?"),
    (2, 0.8, r"{name} (?:version |v)?[0-9]+(?: [0-9]+)*"),
    (3, 0.6, r"{name}"),
)
NOTICE = (1, 0.97)
TAG = (1, 0.98, r"spdx licen[cs]e identifier {tag}")


@dataclass(frozen=True)
class Rule:
    label: str
    gate: str
    pattern: str
    priority: int
    confidence: float
    base: bool = False
    also: tuple[str, ...] = ()  # further gates

    @property
    def gates(self) -> tuple[str, ...]:
        return (self.gate, *self.also)


def default_rules() -> list[Rule]:
    """The rules of ``FAMILIES`` in each of the ``FORMS``, and the base phrases, in order."""
    out = []
    for line in FAMILIES.strip().splitlines():
        label, gates, name, tag = (x.strip() for x in line.replace("\\\\", "\\").split(" | "))
        gate, *also = gates.split()
        out += [Rule(label, gate, form.format(name=f"(?:{name})"), p, c, also=tuple(also)) for p, c, form in FORMS]
        if tag != "-":
            out.append(Rule(label, "spdx", TAG[2].format(tag=f"(?:{tag})"), *TAG[:2]))
    for line in NOTICES.strip().splitlines():
        label, gates, pattern = (x.strip() for x in line.split(" | "))
        gate, *also = gates.replace("unauthori[sz]ed", "unauthorized unauthorised").split()
        out.append(Rule(label, gate, pattern, *NOTICE, also=tuple(also)))
    return out + [Rule(label, phrase.split()[0], phrase, 4, 0.5, True) for phrase, label in BASE.items()]


def _rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.label, gate, f"(?<= )(?:{r.pattern})(?= )", r.priority, r.confidence, r.base) for i, r in enumerate(rules) for gate in r.gates]
    return spark.createDataFrame(rows, "rule int, label string, gate string, pattern string, priority int, confidence double, base boolean")


def detections(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every match: doc_id, text_hash, rule, label, priority, confidence, base, start, end (words, end excluded), suppressed."""
    gates = F.array(*[F.lit(g) for g in sorted({g for r in rules for g in r.gates})])
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("words"))
    gated = base.withColumn("gates", F.array_intersect("words", gates)).filter(F.size("gates") > 0)
    plain = gated.select("doc_id", "text_hash", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("plain"), F.explode("gates").alias("gate"))
    # The rules are a fixed list, so their table is broadcast.
    tried = plain.join(F.broadcast(_rules_table(docs.sparkSession, rules)), "gate").filter(F.expr("plain RLIKE pattern"))
    marked = F.split(F.regexp_replace("plain", F.col("pattern"), F.lit("\u0001$0\u0002")), "\u0001")
    pieces = tried.select("doc_id", "text_hash", "rule", "label", "priority", "confidence", "base", F.posexplode(marked).alias("piece", "said"))
    spaces = lambda c: F.length(c) - F.length(F.translate(c, " ", ""))
    pieces = pieces.select("*", spaces(F.col("said")).alias("spaces"), spaces(F.substring_index("said", "\u0002", 1)).alias("inner")).drop("said")
    # Rows that are repeated in the input, and rules tried for two of their gates, meet here and count once.
    once = pieces.repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "rule", "piece"])
    before = F.sum("spaces").over(W.partitionBy("doc_id", "text_hash", "rule").orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    placed = once.withColumn("start", before - 1).filter("piece > 0").withColumn("end", F.col("start") + F.col("inner") + 1)
    order = W.partitionBy("doc_id", "text_hash").orderBy("start", F.col("end").desc(), "priority", "rule").rowsBetween(W.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") <= p, F.col("end"))).over(order) for p in sorted({r.priority for r in rules})]
    covered = F.lit(False)
    for p, upto in zip(sorted({r.priority for r in rules}), reach):
        covered = F.when(F.col("priority") == p, F.coalesce(upto >= F.col("end"), F.lit(False))).otherwise(covered)
    return placed.withColumn("suppressed", covered).select("doc_id", "text_hash", "rule", "label", "priority", "confidence", "base", "start", "end", "suppressed")


def scan(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: n_words, n_base, first_word, last_word, base_labels, labels, score (and n_detections)."""
    found = detections(docs, rules if rules is not None else default_rules(), doc_id, text)
    base, kept = F.col("base"), ~F.col("suppressed")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_doc = found.groupBy("doc_id", "text_hash").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.when(base | kept, F.col("label"))).alias("labels"),
        (1 - F.exp(F.sum(F.when(kept, F.log(1 - F.col("confidence"))).otherwise(0.0)))).alias("score"), F.count_if(kept).alias("n_detections"),
    )
    each = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), count_words(F.col(text)).alias("n_words"))
    return match(each, by_doc, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)), 9).alias("score"), F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
    )
