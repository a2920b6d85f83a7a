"""Licence scans: sentences to identifiers, identifier sequences to licences."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table
from .license_rules import MORE

#: Sentences of the public notices of licences. Fixed values.
_APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "You may obtain a copy of the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "See the License for the specific language governing permissions and limitations under the License.",
]
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_LIABLE = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    _AS_IS,
    _LIABLE,
]
_GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "See the GNU General Public License for more details.",
]
#: Licence and its sentences in order, as the licences' public notices word them. The SQL knows these.
FIRST: list[tuple[str, list[str]]] = [
    ("Apache-2.0", _APACHE),
    ("MIT", _MIT),
    ("GPL-3.0-or-later", _GPL),
    ("GPL-3.0-or-later", _GPL[:2]),
    ("Apache-2.0", _APACHE[:1]),
    ("MIT", _MIT[:2]),
    ("Apache-2.0", ["Licensed under the Apache License, Version 2.0."]),
    ("MIT", ["Released under the MIT License."]),
    ("MIT", ["Licensed under the MIT License."]),
    ("CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0."]),
    ("CC-BY-4.0", ["Licensed under CC BY 4.0."]),
    ("GPL-3.0-only", ["This work is licensed under the GNU General Public License, version 3."]),
    ("Apache-2.0", ["SPDX-License-Identifier: Apache-2.0"]),
    ("MIT", ["SPDX-License-Identifier: MIT"]),
    ("GPL-3.0-only", ["SPDX-License-Identifier: GPL-3.0-only"]),
    ("GPL-3.0-or-later", ["SPDX-License-Identifier: GPL-3.0-or-later"]),
]
#: A parameter of scan_licenses.
RULES = FIRST + MORE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A line's start up to its first letter or digit, with the comment words of batch files and m4.
_LEADER = r"\n[^\p{L}\p{N}\n\u0001]*+(?:(?:rem|dnl)(?![\p{L}\p{N}_])[^\p{L}\p{N}\n\u0001]*+)?"


_SPDX = "spdx license identifier "
_MARKER = "spdx-license-identifier:"
_NAME_OF = r"neither[ \n]+the[ \n]+name[ \n]+of"
_HOLDER = rf"\A({_NAME_OF})[ \n\u0001][a-z0-9 \n\u0001]+?[ \n\u0001]+nor[ \n]+the[ \n]+names[ \n]+of[ \n]+its[ \n]+contributors"


def normal(sentence: str) -> str:
    plain = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.translate(str.maketrans(UPPER, LOWER)))
    return " ".join(plain.split())


def _compile(rules: list[tuple[str, list[str]]]) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Identifiers of the sentences, and (licence, its sequence as text), longer sequences first."""
    ids: dict[str, int] = {}
    found = []
    for licence, sentences in sorted(rules, key=lambda r: -len(r[1])):
        code = "".join(f"<{ids.setdefault(normal(s), len(ids) + 1)}>" for s in sentences)
        found.append((licence, code))
    if not found or "" in ids:
        raise ValueError("rules need sentences with letters or digits")
    return ids, found


def _pattern(sentences: Iterable[str]) -> str:
    """Group 1: the longest of the sentences that ends with a line or sentence, its words in lines as they come, or any SPDX line; else one line, numbers and letters of lists left out."""
    tree: dict = {}
    for sentence in sentences:
        node = tree
        for word in sentence.split():
            node = node.setdefault(word, {})
        node[""] = {}

    def after(node: dict) -> str:
        longer = either([word + after(n) for word, n in node.items() if word])
        ends = ["(?= *+(?:[\n\u0001]|\\z))"] if "" in node else []
        return either((["[ \n]++" + longer] if longer else []) + ends)

    def either(options: list[str]) -> str:
        return options[0] if len(options) == 1 else f"(?:{'|'.join(options)})" if options else ""

    known = either([word + after(n) for word, n in tree.items()])
    return f"({known}|{_SPDX}[^\n\u0001]*+)|(?!(?:[0-9]{{1,2}}|[a-z]) *+(?:[\n\u0001]|\\z))[a-z0-9][^\n\u0001]*+"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Per row: doc_id, n_known (sentences of the rules that the text holds), licenses, n_matches.

    What stands before a line's first letter or digit (white space, # * // -- ; and so on), and "rem" or "dnl", are
    comment leaders. Sentences end at . ! or ? before white space, or at a line without letters or digits; a known
    one is found from the start of any line or sentence to the end of any, over as many lines as it takes. Other
    lines count as one unknown sentence each.
    Case, punctuation and spacing don't count. A rule matches where its sentences stand in a row; longer rules
    go first and use their sentences up, rules of one length in their order. licenses: the distinct names in
    alphabetical order, joined by commas, "" if none. Null and empty texts have none; repeated rows and null
    ids each give a row, other columns are ignored. Each row is on its own: nothing is shuffled.
    """
    ids, coded = _compile(RULES if rules is None else rules)
    known = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in ids.items())), F.lit(","), F.lit(":"))

    def number(found: Column) -> Column:
        return F.try_element_at(known, found).cast("int")

    def part(x: Column) -> Column:
        name = F.concat(F.lit(_SPDX), F.trim(x))
        return F.coalesce(number(name), number(F.regexp_replace(name, " with .*", "")), F.lit(0))

    def units(found: Column) -> Column:
        whole = F.regexp_replace(found, "[ \n]+", " ")
        parts = F.split(F.regexp_replace(F.trim(whole), f"^{_SPDX}", ""), " or (?!later)| and ")
        return F.when(found == "", F.array(F.lit(0))).when(number(F.trim(whole)).isNotNull(), F.array(number(F.trim(whole)))).otherwise(F.transform(parts, part))

    out = pick(docs, doc_id=id_col, text=text_col)
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)), _LEADER, "\n")
    out = out.select("doc_id", lines.alias("_l"))

    def later(line: Column) -> Column:
        """A line with "or later" for each plus that ends an identifier behind the marker."""
        before = F.concat(F.substring_index(line, _MARKER, 1), F.lit(_MARKER))
        behind = F.regexp_replace(F.substr(line, F.length(before) + 1), r"([a-z0-9])\+", "$1 or later")
        return F.when(F.contains(line, F.lit(_MARKER)), F.concat(before, behind)).otherwise(line)

    plus = F.when(F.contains("_l", F.lit(_MARKER)), F.array_join(F.transform(F.split("_l", "\n"), later), "\n")).otherwise(F.col("_l"))
    marked = F.regexp_replace(plus, r"([.!?])[ \t\r\n]+|\n\n+", "\u0001")
    out = out.select("doc_id", F.regexp_replace(marked, "[^a-z0-9\n\u0001]+", " ").alias("_p"))
    named = F.transform(F.split("_p", f"(?={_NAME_OF})"), lambda part: F.regexp_replace(part, _HOLDER, "$1 the copyright holder nor the names of its contributors"))
    plain = F.when(F.contains("_p", F.lit("neither")), F.array_join(named, "")).otherwise(F.col("_p"))
    out = out.select("doc_id", F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(_pattern(ids)), F.lit(1)), units)).alias("_numbers"))
    out = out.select("doc_id", F.size(F.filter("_numbers", lambda n: n > 0)).cast("long").alias("n_known"), F.array_join(F.transform("_numbers", lambda n: F.concat(F.lit("<"), n.cast("string"), F.lit(">"))), "").alias("_s"))
    # rules of several sentences one after another, each over what the ones before it left; a rule of one sentence is a number's name
    several = [x for x in coded if x[1].count("<") > 1]
    names: dict[str, str] = {}
    for licence, code in coded:
        if code.count("<") == 1:
            names.setdefault(code[1:-1], licence)
    none = F.struct(F.col("_s").alias("s"), F.array().cast("array<string>").alias("names"), F.lit(0).cast("long").alias("n"))

    def use(state: Column, rule: Column) -> Column:
        left = F.replace(state["s"], rule["code"], F.lit("#"))
        n = ((F.length(state["s"]) - F.length(left)) / (F.length(rule["code"]) - 1)).cast("long")
        return F.struct(left.alias("s"), F.when(n > 0, F.array_append(state["names"], rule["licence"])).otherwise(state["names"]).alias("names"), (state["n"] + n).alias("n"))

    if several:
        ordered = F.from_json(F.lit(json.dumps([{"licence": a, "code": b} for a, b in several])), "array<struct<licence:string,code:string>>")
        used = F.when(F.col("n_known") > 0, F.aggregate(ordered, none, use)).otherwise(none)
    else:
        used = none
    out = out.select("doc_id", "n_known", used.alias("_u"))
    by_number = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    single = F.filter(F.transform(F.regexp_extract_all("_u.s", F.lit("<([1-9][0-9]*)>"), F.lit(1)), lambda n: F.try_element_at(by_number, n)), lambda x: x.isNotNull())
    out = out.select("doc_id", "n_known", "_u", single.alias("_one"))
    return out.select("doc_id", "n_known", F.array_join(F.array_sort(F.array_distinct(F.concat("_u.names", "_one"))), ",").alias("licenses"), (F.col("_u.n") + F.size("_one")).alias("n_matches"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """All rules in SQL: lines without comment leaders, runs of lines that make a known sentence, the longest from the left, then rules."""
    ids, coded = _compile(RULES)
    pairs = ", ".join(f"('{k}', {v})" for k, v in ids.items())
    several = [x for x in coded if x[1].count("<") > 1]
    names: dict[str, str] = {}
    for licence, code in coded:
        if code.count("<") == 1:
            names.setdefault(code[1:-1], licence)
    singles = ", ".join(f"({n}, '{licence}')" for n, licence in names.items())
    marker, contributors = _MARKER, "[ \\n]+".join(["nor", "the", "names", "of", "its", "contributors"])
    steps, last = [], "coded"
    for n, (_, code) in enumerate(several):
        carried = "".join(f", m{k}" for k in range(n))
        steps.append(f"s{n} AS (SELECT rid, n_known, replace(s, '{code}', '#') AS s{carried}, (length(s) - length(replace(s, '{code}', '#'))) // {len(code) - 1} AS m{n} FROM {last})")
        last = f"s{n}"
    used = ", ".join(f"CASE WHEN m{n} > 0 THEN '{licence}' END" for n, (licence, _) in enumerate(several))
    stripped = "regexp_replace(regexp_replace(x, '^[^\\p{L}\\p{N}\\x01]*', ''), '^(rem|dnl)([^\\p{L}\\p{N}_\\x01][^\\p{L}\\p{N}\\x01]*|$)', '')"
    later = f"CASE WHEN contains(x, '{marker}') THEN substr(x, 1, strpos(x, '{marker}') + {len(marker) - 1}) || regexp_replace(substr(x, strpos(x, '{marker}') + {len(marker)}), '([a-z0-9])\\+', '\\1 or later', 'g') ELSE x END"
    holder = f"CASE WHEN i > 1 THEN 'neither the name of' || regexp_replace(x, '^[ \\n\\x01][a-z0-9 \\n\\x01]+?[ \\n\\x01]+{contributors}', ' the copyright holder nor the names of its contributors') ELSE x END"
    return f"""
WITH RECURSIVE known(sentence, num) AS MATERIALIZED (VALUES {pairs}),
single(num, name) AS MATERIALIZED (VALUES {singles}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
bare AS (SELECT rid, chr(10) || array_to_string(list_transform(list_transform(string_split(t, chr(10)), lambda x: {stripped}), lambda x: {later}), chr(10)) AS t FROM docs),
marked AS (SELECT rid, regexp_replace(regexp_replace(t, '([.!?])[ \t\r\n]+|\n\n+', chr(1), 'g'), '[^a-z0-9\n\x01]+', ' ', 'g') AS t FROM bare),
plain AS (SELECT rid, CASE WHEN contains(t, 'neither') THEN array_to_string(list_transform(string_split_regex(t, 'neither[ \n]+the[ \n]+name[ \n]+of'), lambda x, i: {holder}), '') ELSE t END AS t FROM marked),
lines AS MATERIALIZED (
  SELECT rid, seg, trim(x) AS s, row_number() OVER (PARTITION BY rid ORDER BY seg, i) AS n FROM (
    SELECT rid, seg, unnest(string_split(part, chr(10))) AS x, unnest(range(len(string_split(part, chr(10))))) AS i FROM (
      SELECT rid, unnest(string_split(t, chr(1))) AS part, unnest(range(len(string_split(t, chr(1))))) AS seg FROM plain)) WHERE trim(x) <> ''),
runs AS (
  SELECT rid, seg, n, CAST(1 AS BIGINT) AS k, s FROM lines l WHERE EXISTS (SELECT 1 FROM known WHERE starts_with(sentence || ' ', l.s || ' '))
  UNION ALL
  SELECT r.rid, r.seg, r.n, r.k + 1, r.s || ' ' || l.s FROM runs r JOIN lines l ON l.rid = r.rid AND l.n = r.n + r.k AND l.seg = r.seg
  WHERE EXISTS (SELECT 1 FROM known WHERE starts_with(sentence || ' ', r.s || ' ' || l.s || ' '))),
whole AS (SELECT rid, n, max(k) AS k, [arg_max(num, k)] AS nums FROM runs JOIN known ON s = sentence GROUP BY rid, n),
spdx AS (
  SELECT rid, n, list(coalesce(a.num, b.num, 0) ORDER BY j) AS nums FROM (
    SELECT rid, n, j, '{_SPDX}' || trim(replace(x, ' or_later', ' or later')) AS name FROM (
      SELECT rid, n, unnest(parts) AS x, unnest(range(len(parts))) AS j FROM (
        SELECT rid, n, string_split_regex(replace(substr(s, {len(_SPDX) + 1}), ' or later', ' or_later'), ' or | and ') AS parts FROM lines WHERE starts_with(s, '{_SPDX}'))))
  LEFT JOIN known a ON a.sentence = name LEFT JOIN known b ON b.sentence = regexp_replace(name, ' with .*', '') GROUP BY rid, n),
hits AS MATERIALIZED (
  SELECT rid, n, k, nums FROM whole UNION ALL SELECT rid, n, 1, nums FROM spdx WHERE (rid, n) NOT IN (SELECT (rid, n) FROM whole)),
walk AS (
  SELECT rid, CAST(1 AS BIGINT) AS n FROM hits GROUP BY rid
  UNION ALL SELECT w.rid, w.n + coalesce(h.k, 1) FROM walk w LEFT JOIN hits h ON h.rid = w.rid AND h.n = w.n WHERE EXISTS (SELECT 1 FROM lines l WHERE l.rid = w.rid AND l.n = w.n)),
units AS (
  SELECT rid, n, unnest(nums) AS num, unnest(range(len(nums))) AS j FROM (
    SELECT w.rid, w.n, coalesce(h.nums, CASE WHEN regexp_matches(l.s, '^([0-9]{{1,2}}|[a-z])$') THEN CAST([] AS INTEGER[]) ELSE [0] END) AS nums
    FROM walk w JOIN lines l ON l.rid = w.rid AND l.n = w.n LEFT JOIN hits h ON h.rid = w.rid AND h.n = w.n)),
coded AS (SELECT rid, count(*) FILTER (WHERE num > 0) AS n_known, string_agg('<' || num || '>', '' ORDER BY n, j) AS s FROM units GROUP BY rid),
{", ".join(steps)},
alone AS (SELECT rid, list(name) AS names FROM (SELECT rid, CAST(unnest(regexp_extract_all(s, '<([1-9][0-9]*)>', 1)) AS BIGINT) AS num FROM {last}) JOIN single USING (num) GROUP BY rid),
found AS (SELECT rid, n_known, list_filter([{used}], lambda v: v IS NOT NULL) || coalesce(names, CAST([] AS VARCHAR[])) AS names, {" + ".join(f"m{n}" for n in range(len(several)))} + coalesce(len(names), 0) AS n_matches FROM {last} LEFT JOIN alone USING (rid))
SELECT doc_id, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known, coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licenses, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches
FROM docs LEFT JOIN found USING (rid)
"""


ORACLE = _oracle()
