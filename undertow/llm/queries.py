"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm import bpe, collocations, decontaminate, embedding_dedup, language_id, license_scan, ngram_jaccard, quality, secret_scan, sharding, toxicity, url_filter, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _residue(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_jaccard.link(table(spark, sf_dir, "documents"), percent=90)
    return members.select("doc_id", "n_shingles", "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_residue(3) == 1, F.lit(False))
    model = language_id.fit(docs.where(~held))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def _joined(spans: Column, rules: tuple) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(spans: Column, place: int) -> Column:
    """How many spans the rule at this place has. (A second lambda parameter would be the element's index.)"""
    return F.size(F.filter(spans, lambda x: x["k"] == place)).cast("long")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.BASE + secret_scan.ADDED
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules)
    base = F.filter("spans", lambda x: x["k"] < len(secret_scan.BASE))
    counts = [_count(F.col("spans"), i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(base, rules), 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), by_words=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "matched", "overlap", "start", "best")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(_residue(4) == 2, F.lit(False))
    model = quality.fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(_residue(3) == 1, F.lit(False))
    model = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, keep=2000)


# Public licence texts and notices to look for, (template, text).
_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3RD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
LICENSE_TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
      http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
      WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("bsd-2-clause", f"{_BSD_2} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD_2} {_BSD_3RD} {_BSD_END}"),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
      version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
      of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
      notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
      FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
      AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-text", f"{_MIT_GRANT} {_DISCLAIMER}"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
      http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
      code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
      granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of
      this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would
      be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed
      or altered from any source distribution."""),
]


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each reported span."""
    templates = spark.createDataFrame(LICENSE_TEMPLATES, "template string, text string")
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), templates, least=0.8)
    return found.select("doc_id", F.explode("licenses").alias("l")).select("doc_id", F.col("l.template").alias("license"), "l.coverage", "l.matched", F.col("l.start").alias("span_start"), F.col("l.end").alias("span_end"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_license_scan, op3_sharding, op4_language_id, op5_secret_scan, op6_bpe, op7_decontaminate, op8_quality, op9_url_filter, op10_embedding_dedup, op11_vector_codes, op12_toxicity, op13_collocations)}


def _secret_sql() -> str:
    """Matches split the text, so lengths of matches and of the parts between them give the places."""
    rules, base = secret_scan.BASE + secret_scan.ADDED, len(secret_scan.BASE)
    parts = []
    for k, r in enumerate(rules):
        rx = r.pattern.replace("'", "''")
        found = f"SELECT doc_id, regexp_extract_all(t, '{rx}') AS m, regexp_extract_all(t, '{rx}', {r.group}) AS o, string_split_regex(t, '{rx}') AS g FROM texts WHERE regexp_matches(t, '{rx}')"
        at = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        parts.append(f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, CAST({at} AS BIGINT) AS s, length(m[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({found})) WHERE length(o[i]) >= {r.least}")
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(secret_scan.BASE))
    one = "kind || ':' || s || ':' || (s + n)"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({" UNION ALL ".join(parts)})
        SELECT doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY s, k) FILTER (k < {base}), '')) AS base_sha256, coalesce(string_agg({one}, ',' ORDER BY s, k), '') AS spans
        FROM documents LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Each round as two tables: the nearest entry of every part, and the entries it leaves."""

    def assigned(k: int) -> str:
        near = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
        return f"a{k} AS MATERIALIZED (SELECT rid, part, x, e, CAST(near AS BIGINT) AS near FROM (SELECT rid, part, x, e, {near} AS near FROM p JOIN c{k} USING (part)) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY near, e) = 1)"

    steps = [assigned(0)]
    for k in range(1, rounds + 1):
        means = f"SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (SELECT part, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{k - 1}) GROUP BY part, e, i) GROUP BY part, e"
        steps += [f"c{k} AS MATERIALIZED (SELECT part, e, coalesce(m, y) AS y FROM c{k - 1} LEFT JOIN ({means}) USING (part, e))", assigned(k)]
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
        c0 AS MATERIALIZED (SELECT part, rid - 1 AS e, x AS y FROM p WHERE rid <= {entries}), {", ".join(steps)},
        books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds}),
        coded AS (SELECT rid, string_agg(lpad(format('{{:x}}', e), 2, '0'), '' ORDER BY part) AS code, CAST(sum(near) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (rid), books"""


# The SQL's own list, as it was: it blocks net/de/, which the contract and URL_RULES allow.
_LISTED = "('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')"

ORACLE_SQL: dict[str, str] = {
    "op10_embedding_dedup": r"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
 sym AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT a, b FROM sym UNION SELECT r.a, y.b FROM reach r JOIN sym y ON y.a = r.b),
 n AS (SELECT a, count(*) AS n FROM sym GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
 SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op7_decontaminate": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents),
 i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS u FROM benchmark),
 dt AS (SELECT doc_id, len(t) AS nd, unnest(t) AS tok, unnest(range(len(t))) AS p FROM d), it AS (SELECT item_id, len(u) AS ni, unnest(u) AS tok, unnest(range(len(u))) AS q FROM i WHERE len(u) >= 6),
 m AS (SELECT doc_id, item_id, p - q AS d, q, least(12, ni) AS w, greatest(0, q - p) AS f, least(ni, nd - (p - q)) AS e FROM dt JOIN it USING (tok)),
 g AS (SELECT *, count(*) OVER x AS n, count(*) OVER (x ORDER BY q RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS c FROM m WHERE e - f >= w WINDOW x AS (PARTITION BY doc_id, item_id, d)),
 b AS (SELECT doc_id, item_id, any_value(n) AS matched, any_value(e - f) AS overlap, any_value(f + d) AS start, greatest(coalesce(max(c) FILTER (q <= e - w), 0), count(*) FILTER (q >= e - w)) AS best, any_value(w) AS w FROM g WHERE n >= w - 1 GROUP BY doc_id, item_id, d)
 SELECT doc_id, item_id, matched, overlap, start, best FROM b WHERE best >= w - 1 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, overlap DESC, start, best DESC) = 1""",
    "op3_sharding": r"""WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
 r AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, x: xor(a >> 8, tab[1 + xor(a & 255, x)])), 4294967295::BIGINT) AS crc FROM documents, tab),
 s AS (SELECT *, sum(size) OVER o - size AS start, row_number() OVER o - 1 AS place, sum(size) OVER () AS total FROM r WINDOW o AS (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT *, least(23, (2 * start + size) * 24 // (2 * total)) AS shard FROM s)
 SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    "op1_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
 e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a, b FROM sym UNION SELECT r.a, y.b FROM reach r JOIN sym y ON y.a = r.b)
 SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(reach.b), s.doc_id)) AS component_id FROM s LEFT JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, s.s""",
    "op5_secret_scan": _secret_sql(),
    "op11_vector_codes": _codes_sql(),
    "op13_collocations": r"""WITH pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
 w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces), totals AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
 grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
 f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
 cuts AS (SELECT lang, c.phrase, a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x USING (lang) JOIN f y USING (lang) JOIN totals USING (lang) WHERE x.phrase = array_to_string(w[:cut], ' ') AND y.phrase = array_to_string(w[cut + 1:], ' ')),
 best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 inside AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM c)) GROUP BY ALL)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < a
 QUALIFY rank <= 2000""",
    "op9_url_filter": f"""WITH rules(action, h, p) AS (VALUES {_LISTED}), u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) ELSE '' END AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
        met AS (SELECT page_id, h || p AS rule, action FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) = 1)
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN met USING (page_id)""",
}
