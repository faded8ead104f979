"""Licence scans by sentence rules (DataFrame and SQL functions only)."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licences and notices, normalised as
# normalised() does (lower case, anything but letters and digits one space).
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "this project is licensed under the mit license",
    4: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    5: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    6: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    7: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    10: "licensed under the apache license version 2 0",
    11: "licensed under the apache license version 2 0 the license",
    12: "you may not use this file except in compliance with the license",
    13: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    14: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    15: "see the license for the specific language governing permissions and limitations under the license",
    16: "you may obtain a copy of the license at",
    17: "http www apache org licenses license 2 0",
    18: "https www apache org licenses license 2 0",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    23: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    24: "see the gnu general public license for more details",
    25: "you should have received a copy of the gnu general public license along with this program",
    26: "this program is distributed in the hope that it will be useful but without any warranty",
    27: "without even the implied warranty of merchantability or fitness for a particular purpose",
    28: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    29: "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    30: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    31: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    32: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    33: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    34: "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    35: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    36: "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    37: "either version 2 of the license or at your option any later version",
    38: "either version 2 1 of the license or at your option any later version",
    39: "either version 3 of the license or at your option any later version",
    40: "licensed under cc by nc 4 0",
    41: "licensed under cc by 4 0",
    42: "licensed under cc by sa 4 0",
    43: "this work is licensed under a creative commons attribution 4 0 international license",
    44: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    45: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    50: "this source code form is subject to the terms of the mozilla public license v 2 0",
    70: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    71: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    72: "this library is distributed in the hope that it will be useful but without any warranty",
    73: "see the gnu lesser general public license for more details",
    74: "you should have received a copy of the gnu lesser general public license along with this library",
    75: "you should have received a copy of the gnu lesser general public license along with this program",
    76: "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    80: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    81: "see the gnu affero general public license for more details",
    82: "you should have received a copy of the gnu affero general public license along with this program",
    83: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    84: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    85: "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    86: "this is free and unencumbered software released into the public domain",
    87: "for more information please refer to http unlicense org",
    88: "for more information please refer to https unlicense org",
    90: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    91: "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0",
    92: "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    93: "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    94: "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    95: "you should have received a copy of the cc0 public domain dedication along with this software",
}

# Licence identifiers in SPDX lines and the licences they stand for.
SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0-or-later", "GPL-2.0-only": "GPL-2.0",
    "BSD-3-Clause": "BSD-3-Clause", "BSD-2-Clause": "BSD-2-Clause", "MPL-2.0": "MPL-2.0", "GPL-2.0-or-later": "GPL-2.0-or-later", "GPL-2.0": "GPL-2.0",
    "GPL-3.0": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1-or-later", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0-or-later",
    "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0-or-later", "ISC": "ISC", "Unlicense": "Unlicense", "EPL-1.0": "EPL-1.0", "EPL-2.0": "EPL-2.0", "CC0-1.0": "CC0-1.0",
    "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
}
FIRST_SPDX = 100              # their sentences' identifiers, in this order

# Licences and the sentence sequences that stand for them, the
# more specific first; a sentence counts for the first rule that takes it.
RULES = [
    ("BSD-3-Clause", [30, 31, 32, 33, 35, 36]),
    ("BSD-3-Clause", [30, 31, 32, 34, 35, 36]),
    ("BSD-3-Clause", [30, 31, 32, 33]),
    ("BSD-3-Clause", [30, 31, 32, 34]),
    ("BSD-2-Clause", [30, 31, 32, 35, 36]),
    ("BSD-2-Clause", [30, 31, 32]),
    ("MIT", [4, 5, 6, 7]),
    ("MIT", [4, 5, 6]),
    ("Apache-2.0", [11, 12, 16, 17, 14, 15]),
    ("Apache-2.0", [11, 12, 16, 18, 14, 15]),
    ("Apache-2.0", [11, 12, 13, 14, 15]),
    ("Apache-2.0", [11, 12]),
    ("GPL-3.0-or-later", [21, 26, 27, 24, 25]),
    ("GPL-3.0-or-later", [28, 39, 26, 27, 24, 25]),
    ("GPL-2.0-or-later", [28, 37, 26, 27, 24, 25]),
    ("GPL-2.0", [29, 26, 27, 24, 25]),
    ("LGPL-2.1-or-later", [70, 38, 72, 27, 73, 74]),
    ("LGPL-3.0-or-later", [70, 39, 72, 27, 73, 74]),
    ("LGPL-3.0-or-later", [71, 72, 27, 73, 74]),
    ("LGPL-3.0-or-later", [76, 26, 27, 73, 75]),
    ("AGPL-3.0-or-later", [80, 26, 27, 81, 82]),
    ("ISC", [83, 84, 85]),
    ("Unlicense", [86, 6, 88]),
    ("Unlicense", [86, 6, 87]),
    ("Unlicense", [86, 88]),
    ("Unlicense", [86, 87]),
    ("GPL-3.0-or-later", [21, 23, 24, 25]),
    ("GPL-2.0-or-later", [22, 23, 24, 25]),
    ("GPL-2.0-or-later", [28, 37]),
    ("GPL-3.0-or-later", [28, 39]),
    ("GPL-2.0", [29]),
    ("LGPL-2.1-or-later", [70, 38]),
    ("LGPL-3.0-or-later", [70, 39]),
    ("LGPL-3.0-or-later", [71]),
    ("LGPL-3.0-or-later", [76]),
    ("AGPL-3.0-or-later", [80]),
    ("ISC", [83]),
    ("Unlicense", [86]),
    ("EPL-2.0", [90]),
    ("EPL-2.0", [91]),
    ("EPL-1.0", [92]),
    ("CC0-1.0", [94, 95]),
    ("CC0-1.0", [93]),
    ("CC0-1.0", [94]),
    ("GPL-3.0-or-later", [21]),
    ("GPL-2.0-or-later", [22]),
    ("MIT", [1]),
    ("MIT", [2]),
    ("MIT", [3]),
    ("Apache-2.0", [10]),
    ("Apache-2.0", [11]),
    ("GPL-3.0", [20]),
    ("CC-BY-NC-4.0", [40]),
    ("CC-BY-4.0", [41]),
    ("CC-BY-SA-4.0", [42]),
    ("CC-BY-4.0", [43]),
    ("CC-BY-SA-4.0", [44]),
    ("CC-BY-NC-4.0", [45]),
    ("MPL-2.0", [50]),
]

for _i, (_id, _name) in enumerate(SPDX.items(), FIRST_SPDX):
    SENTENCES[_i] = " ".join(re.sub(r"[^a-z0-9]+", " ", f"spdx license identifier {_id.lower()}").split())
    RULES.append((_name, [_i]))

#: Every sentence holds one of these, so texts and sentences without any need no look-up.
STEMS = "licen|permission|copyright|warrant|liable|redistribut|public domain"
#: A sentence ends at . ! ? ; before white space, at the end of the text, or before and after a line without letters and digits.
ENDS = r"[.!?;](?=\s|$)|\n[^\p{L}\p{N}\n]*\n"


def _sentences(text: Column) -> Column:
    """The normalised sentences of a text that hold a stem, in order.

    A licence notice may stand on lines of its own without a full stop, and its
    sentences may run over lines: a sentence is looked for as it stands and,
    if it runs over lines, line by line too.
    """
    parts = F.filter(F.split(F.lower(text), ENDS), lambda s: s.rlike(STEMS))
    parts = F.transform(parts, lambda s: F.btrim(s, F.lit(" \t\r\n")))
    both = F.flatten(F.transform(parts, lambda s: F.when(s.contains("\n"), F.concat(F.array(s), F.split(s, "\n"))).otherwise(F.array(s))))
    return F.filter(F.transform(both, normalised), lambda s: s.rlike(STEMS))


def normalised(sentence: Column) -> Column:
    """Lower case; every run of other characters than letters and digits is one space; none at the ends."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id", sentences: dict[int, str] | None = None,
         rules: list[tuple[str, list[int]]] | None = None) -> DataFrame:
    """Every row of docs with the licences that its sentences name.

    Returns <key>, licenses array<string> (in the order of the rules, each
    once), sentence_ids array<int> (the known sentences, in text order) and
    unmatched long (known sentences that no rule took).

    A rule matches where its identifiers stand side by side in the sequence of
    known sentences; other sentences between them do not count.  Rules are
    tried in order, and what one takes is not seen by the next.  Null, empty
    and licence-free texts have no licences and no sentences.  Copies and
    repeated rows are rows of their own.  Texts are scanned whole; rows are
    independent of each other, so nothing is shuffled.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = F.create_map(*[F.lit(x) for i, s in sorted(sentences.items()) for x in (s, i)])
    found = F.when(F.lower(F.col(text)).rlike(STEMS), _sentences(F.col(text))).otherwise(F.array().cast("array<string>"))
    ids = F.filter(F.transform(found, lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())
    out = docs.select(F.col(key), F.coalesce(ids, F.array().cast("array<int>")).alias("sentence_ids"))
    listed = F.concat(F.lit(","), F.concat_ws(",,", F.transform("sentence_ids", lambda i: i.cast("string"))), F.lit(","))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f",{i}," for i in seq)).alias("seq")) for name, seq in rules])
    start = F.struct(listed.alias("rest"), F.array().cast("array<string>").alias("names"))
    step = lambda s, r: F.when(s["rest"].contains(r["seq"]), F.struct(
        F.replace(s["rest"], r["seq"], F.lit(";")).alias("rest"), F.array_append(s["names"], r["name"]).alias("names"))).otherwise(s)
    got = F.when(F.size("sentence_ids") > 0, F.aggregate(table, start, step)).otherwise(
        F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("names")))
    out = out.withColumn("got", got)
    return out.select(key, F.array_distinct("got.names").alias("licenses"), "sentence_ids",
                      F.regexp_count(F.col("got.rest"), F.lit(r"\d+")).cast("long").alias("unmatched"))
