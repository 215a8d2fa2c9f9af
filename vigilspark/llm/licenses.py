"""License scan: ordered signature rules behind a keyword prefilter, overlaps settled by priority and containment.

1. Gate: a text that holds no root of any keyword (``ROOTS``) is done after its word count.
2. Prefilter: other texts meet only the rules of which they hold a keyword. Every match of a rule holds one of the
   rule's keywords (``rule_keywords``), so neither step loses a detection; the SQL runs every rule on every text.
   A rule matches whole words only, where a letter beyond ASCII is a letter like any other.
3. Every match of a rule is a detection (start, end, priority). A detection that lies inside another one of the same
   or a higher priority is suppressed; of equal spans the rule that stands first stays.
4. Labels of what is left join the labels of the base phrases.

Cases: NULL or empty text has no words, no labels and score 0. Repeated rows (same id, same text) give the same row
each. Ties between rules are settled by their order. Extra columns are not read.

No Python runs on the data. The rules are a constant of this module (their count is fixed), so they are broadcast.
Only texts with a keyword reach the regexes; what is shuffled are detections and one digest row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import lower_ascii, query, table, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that is not lower-cased yet.
WORD_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE_PHRASES = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]
#: (label, main word, name of the license as a regex, SPDX identifier as a regex); versions are spelled out by the name.
FAMILIES = [
    ("agpl-3.0", "affero", r"(gnu )?affero general public licen[cs]es?(,? (version |v\.? ?)?3(\.0)?)?", r"agpl-3\.0(-only|-or-later)?"),
    ("apache-1.1", "apache", r"apache( software)? licen[cs]es?,? (version |v\.? ?)?1\.1", r"apache-1\.1"),
    ("apache-2.0", "apache", r"apache( software)? licen[cs]es?,? (version |v\.? ?)?2(\.0)?", r"apache-2\.0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]es?,? (version |v\.? ?)?2(\.0)?", r"artistic-2\.0"),
    ("bsd-2-clause", "bsd", r"(bsd[ -]2[ -]clause|simplified bsd|freebsd)( licen[cs]es?)?", r"bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(bsd[ -]3[ -]clause|new bsd|modified bsd|revised bsd)( licen[cs]es?)?", r"bsd-3-clause"),
    ("bsl-1.0", "boost", r"boost software licen[cs]es?,?( (version |v\.? ?)?1\.0)?", r"bsl-1\.0"),
    ("cc0-1.0", "cc0", r"cc0( 1\.0)?( universal)?", r"cc0-1\.0"),
    ("cc-by", "cc", r"(creative commons |cc[ -])(by|attribution)( |-)?([1-4]\.0)?( international)?", r"cc-by-[1-4]\.0"),
    ("cc-by-nc", "cc", r"(creative commons |cc[ -])(by-nc|attribution-noncommercial)( |-)?([1-4]\.0)?( international)?", r"cc-by-nc-[1-4]\.0"),
    ("cc-by-nd", "cc", r"(creative commons |cc[ -])(by-nd|attribution-noderiv\w*)( |-)?([1-4]\.0)?( international)?", r"cc-by-nd-[1-4]\.0"),
    ("cc-by-sa", "cc", r"(creative commons |cc[ -])(by-sa|attribution-sharealike)( |-)?([1-4]\.0)?( international)?", r"cc-by-sa-[1-4]\.0"),
    ("cc-by-nc-sa", "cc", r"(creative commons |cc[ -])(by-nc-sa|attribution-noncommercial-sharealike)( |-)?([1-4]\.0)?( international)?", r"cc-by-nc-sa-[1-4]\.0"),
    ("cc-by-nc-nd", "cc", r"(creative commons |cc[ -])(by-nc-nd|attribution-noncommercial-noderiv\w*)( |-)?([1-4]\.0)?( international)?", r"cc-by-nc-nd-[1-4]\.0"),
    ("cddl-1.0", "cddl", r"(common development and distribution licen[cs]es?|cddl)( 1\.0)?", r"cddl-1\.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]es?,? (version |- ?v? ?|v\.? ?)?1\.0", r"epl-1\.0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]es?,? (version |- ?v? ?|v\.? ?)?2\.0", r"epl-2\.0"),
    ("eupl-1.2", "eupl", r"(european union public licen[cs]es?|eupl)(,? (version |v\.? ?)?1\.2)?", r"eupl-1\.2"),
    ("gpl-1.0", "general public", r"(gnu )?general public licen[cs]es?,? (version |v\.? ?)?1(\.0)?", r"gpl-1\.0(-only|-or-later)?"),
    ("gpl-2.0", "general public", r"(gnu )?general public licen[cs]es?,? (version |v\.? ?)?2(\.0)?", r"gpl-2\.0(-only|-or-later)?"),
    ("gpl-3.0", "general public", r"(gnu )?general public licen[cs]es?,? (version |v\.? ?)?3(\.0)?", r"gpl-3\.0(-only|-or-later)?"),
    ("lgpl-2.1", "lesser", r"(gnu )?lesser general public licen[cs]es?,? (version |v\.? ?)?2\.1", r"lgpl-2\.1(-only|-or-later)?"),
    ("lgpl-3.0", "lesser", r"(gnu )?lesser general public licen[cs]es?,? (version |v\.? ?)?3(\.0)?", r"lgpl-3\.0(-only|-or-later)?"),
    ("lgpl-2.0", "library", r"(gnu )?library general public licen[cs]es?,? (version |v\.? ?)?2(\.0)?", r"lgpl-2\.0(-only|-or-later)?"),
    ("gfdl", "documentation", r"(gnu )?free documentation licen[cs]es?(,? (version |v\.? ?)?1\.[1-3])?", r"gfdl-1\.[1-3](-only|-or-later)?"),
    ("isc", "isc", r"isc licen[cs]es?", r"isc"),
    ("mit", "mit", r"(mit|expat) licen[cs]es?", r"mit"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]es?,? (version |v\.? ?)?1\.1", r"mpl-1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]es?,? (version |v\.? ?)?2\.0", r"mpl-2\.0"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]es?", r"ms-pl"),
    ("odbl-1.0", "open d", r"open database licen[cs]es?|open data commons open database licen[cs]es?", r"odbl-1\.0"),
    ("ofl-1.1", "open font", r"(sil )?open font licen[cs]es?(,? (version |v\.? ?)?1\.1)?", r"ofl-1\.1"),
    ("openssl", "openssl", r"openssl licen[cs]es?", r"openssl"),
    ("postgresql", "postgresql", r"postgresql licen[cs]es?", r"postgresql"),
    ("psf-2.0", "python", r"python software foundation licen[cs]es?(,? (version |v\.? ?)?2)?", r"psf-2\.0"),
    ("unlicense", "unlicense", r"the unlicense|unlicense", r"unlicense"),
    ("wtfpl", "what the", r"do what the f\w+ you want to public licen[cs]es?", r"wtfpl"),
    ("zlib", "zlib", r"zlib(/libpng)? licen[cs]es?", r"zlib"),
]
#: (priority, confidence, regex around a name): a grant outranks a heading, which outranks a bare mention.
FRAMES = [
    (40, 0.99, r"licensed under( the)?( terms of( the)?)? {name}"),
    (40, 0.97, r"(released|distributed|available|published|provided|made available) under( the)?( terms of( the)?)? {name}"),
    (38, 0.95, r"(subject to|governed by|covered by|under)( the)? terms (of|and conditions of)( the)? {name}"),
    (35, 0.93, r"(see|read|refer to)( the)? {name}( for (more )?details)?"),
    (30, 0.9, r"licen[cs]e ?: ?(the )?{name}"),
    (10, 0.8, r"{name}"),
]
_CC = ("cc by", "cc-by", "cc attribution", "cc-attribution", "creative commons by", "creative commons attribution")
#: Keywords of the families: every match of a name holds one of them, whichever alternatives it takes.
KEYWORDS = {
    "agpl-3.0": ("affero general public licen",),
    "apache-1.1": ("apache licen", "apache software licen"),
    "apache-2.0": ("apache licen", "apache software licen"),
    "artistic-2.0": ("artistic licen",),
    "bsd-2-clause": ("bsd 2", "bsd-2", "simplified bsd", "freebsd"),
    "bsd-3-clause": ("bsd 3", "bsd-3", "new bsd", "modified bsd", "revised bsd"),
    "bsl-1.0": ("boost software licen",),
    "cc0-1.0": ("cc0",),
    "cc-by": _CC,
    "cc-by-nc": _CC,
    "cc-by-nd": _CC,
    "cc-by-sa": _CC,
    "cc-by-nc-sa": _CC,
    "cc-by-nc-nd": _CC,
    "cddl-1.0": ("cddl", "common development and distribution licen"),
    "epl-1.0": ("eclipse public licen",),
    "epl-2.0": ("eclipse public licen",),
    "eupl-1.2": ("eupl", "european union public licen"),
    "gpl-1.0": ("general public licen",),
    "gpl-2.0": ("general public licen",),
    "gpl-3.0": ("general public licen",),
    "lgpl-2.1": ("lesser general public licen",),
    "lgpl-3.0": ("lesser general public licen",),
    "lgpl-2.0": ("library general public licen",),
    "gfdl": ("free documentation licen",),
    "isc": ("isc licen",),
    "mit": ("mit licen", "expat licen"),
    "mpl-1.1": ("mozilla public licen",),
    "mpl-2.0": ("mozilla public licen",),
    "ms-pl": ("microsoft public licen",),
    "odbl-1.0": ("open database licen",),
    "ofl-1.1": ("open font licen",),
    "openssl": ("openssl licen",),
    "postgresql": ("postgresql licen",),
    "psf-2.0": ("python software foundation licen",),
    "unlicense": ("unlicense",),
    "wtfpl": ("you want to public licen",),
    "zlib": ("zlib licen", "zlib/libpng licen"),
}
SPDX = "spdx-license-identifier"
#: Rules with wording of their own: (label, keyword, priority, confidence, regex).
SINGLE = [
    ("mit", "permission is hereby", 50, 0.99, r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission to use", 50, 0.95, r"permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("bsd", "redistribution", 50, 0.95, r"redistribution and use in source and binary forms, with or without modification"),
    ("public-domain", "public domain", 30, 0.9, r"(released|placed|dedicated) (in|into|to) the public domain"),
    ("public-domain", "public domain", 10, 0.6, r"public domain"),
    ("proprietary", "all rights", 10, 0.5, r"all rights reserved"),
    ("gpl", "general public", 10, 0.7, r"(gnu )?general public licen[cs]es?"),
    ("apache", "apache", 10, 0.7, r"apache( software)? licen[cs]es?"),
    ("lgpl", "lesser", 10, 0.7, r"(gnu )?lesser general public licen[cs]es?"),
    ("mpl", "mozilla", 10, 0.7, r"mozilla public licen[cs]es?"),
    ("epl", "eclipse", 10, 0.7, r"eclipse public licen[cs]es?"),
    ("bsd", "bsd", 10, 0.7, r"bsd licen[cs]es?"),
]
#: Wording of license texts, file headers and notices: (label, keyword, priority, confidence, regex).
BODIES = [
    ("mit", "substantial portions of the software", 50, 0.97, r"the above copyright notice and this permission notice (\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software"),
    ("mit", "to deal in the software", 50, 0.95, r"to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish"),
    ("mit-0", "without restriction", 52, 0.9, r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the .software.\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("isc", "with or without fee", 50, 0.96, r"permission to use, copy, modify, and(/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "with or without fee", 51, 0.9, r"for any purpose with or without fee is hereby granted\. the software is provided"),
    ("bsd-3-clause", "endorse or promote products", 55, 0.97, r"neither the name of [a-z0-9 ,.'<>()-]{1,120} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", 56, 0.97, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "in binary form must reproduce", 50, 0.96, r"redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    ("bsd", "of source code must retain", 50, 0.96, r"redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("apache-2.0", "you may not use this file except in compliance", 55, 0.99, r"you may not use this file except in compliance with the license\. you may obtain a copy of the license at"),
    ("apache-2.0", "www.apache.org/licenses/license-2.0", 55, 0.99, r"https?://www\.apache\.org/licenses/license-2\.0"),
    ("apache-2.0", "january 2004", 54, 0.95, r"apache license,? version 2\.0,? january 2004"),
    ("apache-2.0", "distributed on an", 45, 0.85, r"distributed on an .as is. basis, without warranties or conditions of any kind"),
    ("apache-1.1", "apache software foundation", 52, 0.9, r"this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute it and/or modify it under the terms of the gnu general public", 50, 0.97, r"(this program|this file|it) is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-2.0", "either version 2 of the licen", 55, 0.98, r"gnu general public licen[cs]e as published by the free software foundation[;,] either version 2 of the licen[cs]e"),
    ("gpl-3.0", "either version 3 of the licen", 55, 0.98, r"gnu general public licen[cs]e as published by the free software foundation[;,] either version 3 of the licen[cs]e"),
    ("gpl-2.0", "version 2, june 1991", 55, 0.97, r"gnu general public licen[cs]e version 2, june 1991"),
    ("gpl-3.0", "version 3, 29 june 2007", 55, 0.97, r"gnu general public licen[cs]e version 3, 29 june 2007"),
    ("gpl", "without even the implied warranty", 40, 0.85, r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public licen[cs]e"),
    ("lgpl", "redistribute it and/or modify it under the terms of the gnu lesser", 55, 0.98, r"(this library|this program) is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("lgpl-2.1", "version 2.1, february 1999", 56, 0.97, r"gnu lesser general public licen[cs]e version 2\.1, february 1999"),
    ("lgpl-2.0", "redistribute it and/or modify it under the terms of the gnu library", 55, 0.97, r"redistribute it and/or modify it under the terms of the gnu library general public licen[cs]e"),
    ("agpl-3.0", "version 3, 19 november 2007", 56, 0.98, r"gnu affero general public licen[cs]e version 3, 19 november 2007"),
    ("agpl-3.0", "remote network interaction", 50, 0.9, r"remote network interaction; use with the gnu general public licen[cs]e"),
    ("mpl-2.0", "source code form is subject to the terms", 55, 0.99, r"this source code form is subject to the terms of the mozilla public licen[cs]e, v\. 2\.0"),
    ("mpl-2.0", "mozilla.org/mpl/2.0", 55, 0.98, r"https?://(www\.)?mozilla\.org/mpl/2\.0"),
    ("mpl-1.1", "subject to the mozilla public license version 1.1", 55, 0.98, r"contents of this file are subject to the mozilla public license version 1\.1"),
    ("epl", "accompanying materials are made available under", 50, 0.96, r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("epl-2.0", "eclipse.org/legal/epl-2.0", 55, 0.98, r"https?://(www\.)?eclipse\.org/legal/epl-2\.0"),
    ("epl-1.0", "eclipse.org/legal/epl-v10", 55, 0.98, r"https?://(www\.)?eclipse\.org/legal/epl-v10"),
    ("bsl-1.0", "boost.org/license_1_0", 55, 0.98, r"https?://(www\.)?boost\.org/license_1_0\.txt"),
    ("bsl-1.0", "covered by this license", 52, 0.95, r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "altered source versions must be plainly marked", 55, 0.98, r"altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software must not be misrepresented", 55, 0.98, r"the origin of this software must not be misrepresented"),
    ("ofl-1.1", "reserved font name", 45, 0.9, r"with reserved font names?"),
    ("ofl-1.1", "font software is licensed under the sil", 55, 0.98, r"this font software is licensed under the sil open font licen[cs]e"),
    ("unlicense", "free and unencumbered software", 55, 0.99, r"this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "creativecommons.org/publicdomain/zero", 55, 0.99, r"https?://creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by", "creativecommons.org/licenses/by/", 55, 0.99, r"https?://creativecommons\.org/licenses/by/[1-4]\.[05]"),
    ("cc-by-sa", "creativecommons.org/licenses/by-sa/", 55, 0.99, r"https?://creativecommons\.org/licenses/by-sa/[1-4]\.[05]"),
    ("cc-by-nc", "creativecommons.org/licenses/by-nc/", 55, 0.99, r"https?://creativecommons\.org/licenses/by-nc/[1-4]\.[05]"),
    ("cc-by-nd", "creativecommons.org/licenses/by-nd/", 55, 0.99, r"https?://creativecommons\.org/licenses/by-nd/[1-4]\.[05]"),
    ("cc-by-nc-sa", "creativecommons.org/licenses/by-nc-sa/", 55, 0.99, r"https?://creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]"),
    ("cc-by-nc-nd", "creativecommons.org/licenses/by-nc-nd/", 55, 0.99, r"https?://creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]"),
    ("wtfpl", "you want to", 55, 0.95, r"you just do what the f\w+ you want to"),
    ("postgresql", "without a written agreement is hereby granted", 52, 0.92, r"without fee, and without a written agreement is hereby granted"),
    ("openssl", "openssl project for use in", 52, 0.95, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("psf-2.0", "between the python software foundation", 52, 0.95, r"this license agreement is between the python software foundation"),
    ("artistic-2.0", "artistic license 2.0 copyright", 30, 0.6, r"artistic license 2\.0 copyright"),
    ("proprietary", "proprietary and confidential", 30, 0.8, r"(strictly )?proprietary and confidential"),
    ("proprietary", "copying of this file", 35, 0.85, r"unauthori[sz]ed copying of this file,? via any medium,? is strictly prohibited"),
]


#: Every keyword holds one of these; they have no white space, so a text is asked for them before anything is made of it.
ROOTS = (
    "licen", "bsd", "cc", "commons", "cddl", "eupl", "want", "domain", "rights", "public", "permission", "redistribut", "apache", "mozilla", "eclipse", "lesser", "software", "restriction",
    "without", "products", "advertising", "binary", "retain", "2004", "distributed", "1991", "2007", "1999", "remote", "accompanying", "subject", "boost", "plainly", "misrepresented", "reserved",
    "openssl", "python", "proprietary", "copying", "file",
)


def signature_rules() -> list[tuple[int, str, str, int, float, str]]:
    """(order, label, keyword, priority, confidence, regex), written for lower-case text with single spaces."""
    rules = [(label, word, p, conf, frame.replace("{name}", f"({name})")) for label, word, name, _ in FAMILIES for p, conf, frame in FRAMES]
    rules += [(label, "spdx", 60, 1.0, rf"spdx-license-identifier: ?({spdx})") for label, _, _, spdx in FAMILIES]
    rules = [(*rule[:-1], rf"\b({rule[-1]})\b") for rule in rules + SINGLE + BODIES]
    return [(k, *rule) for k, rule in enumerate(rules)]


def rule_keywords() -> list[tuple[str, ...]]:
    """Keywords of every rule, in the order of ``signature_rules``."""
    named = [KEYWORDS[label] for label, *_ in FAMILIES for _ in FRAMES]
    return [*named, *[(SPDX,) for _ in FAMILIES], *[(word,) for _, word, *_ in SINGLE + BODIES]]


def _spans(rule: str = "regex"):
    """Every match of a rule in ``t`` as (start, end): lengths of the pieces between matches and of the matches add up."""
    hits = F.regexp_extract_all("t", F.col(rule), F.lit(0))
    gaps = F.split("t", F.col(rule), -1)
    lengths = F.zip_with(F.transform(gaps, lambda x: F.length(x)), F.transform(hits, lambda x: F.length(x)), lambda g, h: F.struct(g.alias("g"), F.coalesce(h, F.lit(0)).alias("h")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["g"] + x["h"]).alias("at"), F.when(x["h"] > 0, F.array_append(a["out"], F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["h"]).alias("e")))).otherwise(a["out"]).alias("out"))
    return F.aggregate(lengths, zero, step)["out"]


def detections(docs: DataFrame) -> DataFrame:
    """(id, th, label, priority, confidence, s, e): matches that no other match suppresses."""
    spark = docs.sparkSession
    words = rule_keywords()
    rules = spark.createDataFrame([(k, label, "|".join(words[k]), p, conf, regex) for k, label, _, p, conf, regex in signature_rules()], "ord int, label string, keyword string, priority int, confidence double, regex string")
    # bound by a lambda, so that the text is lower-cased once for all roots
    may = docs.where(F.exists(F.array(lower_ascii(text_or_empty())), lambda t: _any([F.contains(t, F.lit(x)) for x in ROOTS])))
    may = may.select("doc_id", "text", lower_ascii(text_or_empty()).alias("lower"))
    texts = may.select(F.col("doc_id").alias("id"), F.xxhash64(text_or_empty()).alias("th"), F.regexp_replace(F.regexp_replace("lower", r"[\x20\x09-\x0D]+", " "), r"[^\x00-\x7F]", "x").alias("t"))
    keywords = F.array(*[F.when(_any([_held(x) for x in own]), F.lit("|".join(own))) for own in sorted(set(words))])
    met = texts.select("id", "th", "t", F.explode(F.filter(keywords, lambda k: k.isNotNull())).alias("keyword"))
    hits = met.join(F.broadcast(rules), "keyword").select("id", "th", "ord", "label", "priority", "confidence", F.inline(_spans()))
    # the furthest end of any match that starts at or before this one, among matches of the same or a higher rank
    ranks = sorted({r[3] for r in signature_rules()})
    doc = W.partitionBy("id", "th").orderBy("s", F.desc("e"), F.desc("priority"), "ord").rowsBetween(W.unboundedPreceding, -1)
    same = W.partitionBy("id", "th", "s", "e").orderBy(F.desc("priority"), "ord")
    hits = hits.dropDuplicates(["id", "th", "s", "e", "ord"])
    for r in ranks:
        hits = hits.withColumn(f"far{r}", F.max(F.when(F.col("priority") >= r, F.col("e"))).over(doc))
    far = F.coalesce(*[F.when(F.col("priority") == r, F.col(f"far{r}")) for r in ranks], F.lit(-1))
    return hits.withColumn("nth", F.row_number().over(same)).where((F.col("nth") == 1) & (far < F.col("e"))).select("id", "th", "label", "priority", "confidence", "s", "e")


def scan(docs: DataFrame) -> DataFrame:
    """The digest of every document: counts of base phrases, their places, labels and a score."""
    t = text_or_empty()
    rows = docs.select("doc_id", F.xxhash64(t).alias("th"), t.alias("t"))
    listed = F.regexp_extract_all(lower_ascii(F.col("t")), F.lit(WORD), F.lit(0))
    rows = rows.select("doc_id", "th", F.regexp_count("t", F.lit(WORD_ANY)).cast("long").alias("n_words"), F.when(F.rlike("t", F.lit("(?i)license")), listed).otherwise(F.array().cast("array<string>")).alias("w"))

    def starts(phrase: list[str]):
        return F.filter(F.transform("w", lambda x, i: F.when(_all([F.get("w", i + k) == p for k, p in enumerate(phrase)]), i)), lambda i: i.isNotNull())

    rows = rows.select("doc_id", "th", "n_words", *[starts(p).alias(f"at_{label}") for label, p in BASE_PHRASES])
    places = F.concat(*[f"at_{label}" for label, _ in BASE_PHRASES])
    found = F.filter(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label, _ in BASE_PHRASES]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "th", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.array_sort(found).alias("base"))
    kept = detections(docs).groupBy("id", "th").agg(F.collect_set("label").alias("more"), F.max("confidence").alias("confidence")).withColumnRenamed("th", "gth")
    out = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("gth")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("confidence", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.8)).otherwise(F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def _held(keyword: str):
    """The text has the keyword; "cc" only at the start of a word, since hexadecimal numbers hold it too."""
    held = F.contains("t", F.lit(keyword))
    return held & F.rlike("t", F.lit(rf"\b{keyword}")) if keyword.startswith("cc") else held


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


_RULES = ",\n".join("(" + ", ".join(map(_quoted, r)) + ")" for r in signature_rules())
_PHRASES = ", ".join(f"('{label}', ['{"', '".join(p)}'])" for label, p in BASE_PHRASES)

ORACLE_SQL = rf"""
WITH rules(ord, label, keyword, priority, confidence, regex) AS (VALUES {_RULES}),
phrases(label, p) AS (VALUES {_PHRASES}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
b AS (SELECT r, i - 1 AS pos, phrases.label FROM w, phrases, unnest(range(1, len(w) + 1)) AS u(i) WHERE contains(t, 'license') AND w[i:i + len(p) - 1] = p),
g AS (SELECT r, regexp_replace(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g'), '[^\x00-\x7F]', 'x', 'g') AS t FROM d),
m AS (SELECT r, ord, label, priority, confidence, regexp_extract_all(g.t, regex) AS hits, string_split_regex(g.t, regex) AS gaps
    FROM g, rules WHERE regexp_matches(g.t, regex)),
s AS (SELECT r, ord, label, priority, confidence, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS s, length(hits[k]) AS n
    FROM m, unnest(range(1, len(hits) + 1)) AS u(k)),
x AS (SELECT a.* FROM s a WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.r = a.r AND c.s <= a.s AND c.s + c.n >= a.s + a.n AND (
    CASE WHEN c.s = a.s AND c.n = a.n THEN c.priority > a.priority OR (c.priority = a.priority AND c.ord < a.ord) ELSE c.priority >= a.priority END))),
l AS (SELECT r, label FROM x UNION SELECT r, label FROM b),
ll AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM l GROUP BY r),
bb AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
cc AS (SELECT r, max(confidence) AS c FROM x GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(coalesce(c, 0), CASE WHEN n_base > 0 THEN 0.8 ELSE 0 END)::DOUBLE AS score
FROM w LEFT JOIN bb USING (r) LEFT JOIN ll USING (r) LEFT JOIN cc USING (r)
"""


@query("op10_license_scan", ORACLE_SQL)
def op10_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
