"""DuckDB SQL for the queries, over the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ORACLE["normalize_text_docs"] = f"SELECT doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS normal, trim(regexp_replace(text, '{WS}+', ' ', 'g')) IN ('', '-') AS missing FROM documents"

NUMBERS = """r AS (SELECT o_orderkey AS k, CASE o_orderkey % 13 WHEN 0 THEN o_orderkey || ',000' WHEN 1 THEN 'Rp ' || o_orderkey || '.50' WHEN 2 THEN '-' || o_orderkey || ',5 EUR'
  WHEN 3 THEN '1.' || o_orderkey WHEN 4 THEN 'x' || o_orderkey WHEN 5 THEN o_orderkey || ' x' WHEN 6 THEN 'EUR' WHEN 7 THEN '1.234.' || o_orderkey WHEN 8 THEN o_orderkey || '.'
  WHEN 9 THEN '1,' || o_orderkey || '.25' WHEN 10 THEN '1.2.3' || o_orderkey WHEN 11 THEN '+00' || o_orderkey ELSE '-' END AS raw FROM orders)"""
_READ = r"""SELECT k, raw, CASE WHEN error IS NULL THEN CAST(CAST(plain AS DECIMAL(18,6)) AS DOUBLE) END AS value,
  CASE WHEN error IS NULL THEN regexp_replace(regexp_replace(plain, '^\+|\.$', '', 'g'), '^(-?)0+([0-9])', '\1\2') END AS value_text, error FROM e"""
_OUT = r"NOT regexp_matches(plain, '^[-+]?0*[0-9]{1,12}(\.[0-9]{0,6}0*)?$') THEN 'out_of_range'"
ORACLE["parse_amount_grouped"] = rf"""WITH {NUMBERS}, t AS (SELECT *, regexp_extract(raw, '[-+]?[0-9][0-9.,]*') AS token FROM r), p AS (SELECT *, translate(token, '.,', '') AS plain FROM t),
e AS (SELECT *, CASE WHEN token = '' THEN 'no_numeric_amount' WHEN {_OUT} END AS error FROM p) {_READ}"""
ORACLE["parse_quantity"] = rf"""WITH {NUMBERS}, t AS (SELECT *, regexp_extract(raw, '[-+]?[0-9]+([.,][0-9]+)?') AS token FROM r), p AS (SELECT *, replace(token, ',', '.') AS plain FROM t),
e AS (SELECT *, CASE WHEN token = '' THEN 'no_numeric_quantity' WHEN {_OUT} WHEN CAST(plain AS DOUBLE) <= 0 THEN 'non_positive_quantity' END AS error FROM p) {_READ}"""
ORACLE["parse_amount_eu"] = rf"""WITH {NUMBERS}, t AS (SELECT *, regexp_extract(raw, '[-+]?[0-9][0-9.,]*') AS token FROM r),
c AS (SELECT *, instr(reverse(token), ',') AS comma, instr(reverse(token), '.') AS dot FROM t),
p AS (SELECT *, CASE WHEN comma > 0 AND dot > 0 THEN CASE WHEN comma < dot THEN replace(replace(token, '.', ''), ',', '.') ELSE replace(token, ',', '') END
  WHEN comma > 0 THEN replace(token, ',', '.') WHEN dot = 4 THEN replace(token, '.', '') ELSE token END AS plain FROM c),
e AS (SELECT *, CASE WHEN token = '' THEN 'no_numeric_amount' WHEN NOT regexp_matches(plain, '^[-+]?[0-9]+(\.[0-9]*)?$') THEN 'invalid_amount' WHEN {_OUT} END AS error FROM p) {_READ}"""
ORACLE["amount_format_hist"] = rf"""WITH {NUMBERS} SELECT CASE WHEN contains(raw, ',') AND contains(raw, '.') THEN 'mixed_separators' WHEN contains(raw, ',') THEN 'comma' WHEN contains(raw, '.') THEN 'dot' ELSE 'digits_only' END
  || CASE WHEN regexp_matches(raw, '[^0-9 .,+-]') THEN '_with_affix' ELSE '_plain' END AS format, count(*) AS n FROM r GROUP BY 1"""
ORACLE["quantity_format_hist"] = rf"""WITH {NUMBERS}, t AS (SELECT lower(replace(raw, ' ', '')) AS t FROM r) SELECT CASE WHEN regexp_matches(t, '^[0-9]+$') THEN 'integer' WHEN regexp_matches(t, '^[0-9]+[.,][0-9]+$') THEN 'decimal'
  WHEN regexp_matches(t, 'x[0-9]') THEN 'x_before_number' WHEN regexp_matches(t, '[0-9]([.,][0-9]+)?x') THEN 'x_after_number' ELSE 'other' END AS format, count(*) AS n FROM t GROUP BY 1"""

BASE = """li AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS i,
    p_name AS descr, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(p_retailprice AS DECIMAL(18,2)) AS u FROM lineitem JOIN part ON l_partkey = p_partkey),
gi AS (SELECT *, CAST(CAST(q AS DECIMAL(38,2)) * u AS DECIMAL(18,2)) AS lt, (31 * k + 7 * i) % 23 AS h FROM li),
gd AS (SELECT k, o_custkey AS customer, subtotal, CASE WHEN k % 4 <> 0 THEN CAST(round(subtotal * CAST(0.19 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) END AS tax
    FROM (SELECT k, CAST(sum(lt) AS DECIMAL(18,2)) AS subtotal FROM gi GROUP BY k) JOIN orders ON o_orderkey = k),
pi AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS i, CASE WHEN h = 5 THEN upper(descr) ELSE descr END AS descr, q, u, lt + CASE WHEN h = 0 THEN 1 ELSE 0 END AS lt, h <> 3 AS has_d, h <> 1 AS has_q, h <> 2 AS has_t, h = 3 AS doubt FROM gi WHERE h <> 4),
pd AS (SELECT k, gd.subtotal + CASE k % 17 WHEN 4 THEN 0.01 WHEN 5 THEN 0.02 ELSE 0 END AS subtotal, CASE WHEN k % 19 <> 7 THEN gd.tax END AS tax, CASE WHEN k % 17 NOT IN (0, 1) THEN gd.subtotal + coalesce(gd.tax, 0) + CASE WHEN k % 17 = 2 THEN 5 ELSE 0 END END AS total,
    CASE k % 17 WHEN 0 THEN 'not_present' WHEN 1 THEN 'unreadable' WHEN 3 THEN 'uncertain' ELSE 'extracted' END AS total_status, k % 13 = 0 AS low,
    CASE customer % 5 WHEN 0 THEN 'USD' WHEN 1 THEN NULL ELSE CASE WHEN k % 19 = 8 THEN 'eur' ELSE 'EUR' END END AS currency FROM gd),
ps AS (SELECT k, count(*) AS n, CASE WHEN bool_and(has_t) THEN sum(lt) END AS summed FROM pi GROUP BY k),
pt AS (SELECT pd.*, coalesce(n, 0) AS n, summed FROM pd LEFT JOIN ps USING (k)),
v1 AS (SELECT k, CASE WHEN total_status = 'unreadable' THEN 'UNREADABLE_CRITICAL_FIELD' ELSE 'MISSING_CRITICAL_FIELD' END AS code, 'total' AS field_path, total_status AS status FROM pd WHERE total_status <> 'extracted'
    UNION ALL SELECT k, 'MISSING_CRITICAL_FIELD', 'currency', 'not_present' FROM pd WHERE currency IS NULL
    UNION ALL SELECT k, 'MISSING_CRITICAL_FIELD', 'line_items[' || i || '].description', 'uncertain' FROM pi WHERE NOT has_d
    UNION ALL SELECT k, 'MISSING_CRITICAL_FIELD', 'line_items[' || i || '].line_total', 'not_present' FROM pi WHERE NOT has_t),
v2 AS (SELECT k, 'total' AS field_path, CASE total_status WHEN 'uncertain' THEN 'total is marked uncertain' ELSE 'total has confidence 0.30, less than 0.50' END AS message FROM pd WHERE total_status = 'uncertain' OR (total_status = 'extracted' AND low)
    UNION ALL SELECT k, 'line_items[' || i || '].description', 'line_items[' || i || '].description is marked uncertain' FROM pi WHERE doubt),
v3 AS (SELECT k, i FROM pi WHERE has_q AND has_t AND abs(CAST(q AS DECIMAL(38,2)) * u - lt) > 0.01),
v4 AS (SELECT k, 'subtotal' AS first_path, 1 + n AS n_paths, 1 AS rule FROM pt WHERE n > 0 AND abs(summed - subtotal) > 0.01
    UNION ALL SELECT k, 'subtotal', 3, 2 FROM pt WHERE tax IS NOT NULL AND total_status = 'extracted' AND abs(subtotal + tax - total) > 0.01
    UNION ALL SELECT k, 'total', 1 + n, 3 FROM pt WHERE tax IS NULL AND n > 0 AND total_status = 'extracted' AND abs(summed - total) > 0.01),
v5 AS (SELECT k FROM pd WHERE currency <> 'EUR'),
va AS (SELECT k, CASE code WHEN 'UNREADABLE_CRITICAL_FIELD' THEN 'unreadable_content' ELSE 'missing_critical_field' END AS reason FROM v1 UNION ALL SELECT k, 'low_confidence' FROM v2
    UNION ALL SELECT k, 'validation_error' FROM v3 UNION ALL SELECT k, 'validation_error' FROM v4 UNION ALL SELECT k, 'validation_error' FROM v5),
dec AS (SELECT pd.k, count(reason) > 0 AS requires_review, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons, count(reason) AS n_issues FROM pd LEFT JOIN va USING (k) GROUP BY pd.k)"""
ORACLE["critical_fields"] = f"WITH {BASE} SELECT CAST(k AS VARCHAR) AS document_id, code, field_path, field_path || CASE code WHEN 'UNREADABLE_CRITICAL_FIELD' THEN ' can''t be read, so the receipt can''t be accepted unseen' ELSE ' is needed to accept the receipt unseen; its status is ' || status END AS message FROM v1"
ORACLE["low_confidence"] = f"WITH {BASE} SELECT CAST(k AS VARCHAR) AS document_id, field_path, message FROM v2"
_PLAIN = lambda x: rf"regexp_replace(CAST({x} AS VARCHAR), '\.?0+$', '')"
ORACLE["line_total_check"] = f"""WITH {BASE} SELECT CAST(k AS VARCHAR) AS document_id, 'line_items[' || i || '].quantity,line_items[' || i || '].unit_price,line_items[' || i || '].line_total' AS field_paths,
  q || ' times ' || u || ' is ' || {_PLAIN("CAST(q AS DECIMAL(18,2)) * CAST(u AS DECIMAL(18,2))")} || ', not ' || CAST(lt AS DECIMAL(18,2)) AS message FROM v3 JOIN pi USING (k, i)"""
ORACLE["doc_total_check"] = f"""WITH {BASE} SELECT CAST(k AS VARCHAR) AS document_id, first_path, CAST(n_paths AS BIGINT) AS n_paths, CASE WHEN rule = 2 THEN 'subtotal and tax add up to ' || {_PLAIN("CAST(subtotal + tax AS DECIMAL(18,2))")} || ', not to the total ' || CAST(total AS DECIMAL(18,2))
  ELSE 'the line totals add up to ' || {_PLAIN("CAST(summed AS DECIMAL(18,2))")} || ', not to the ' || CASE rule WHEN 1 THEN 'subtotal ' || CAST(subtotal AS DECIMAL(18,2)) ELSE 'total ' || CAST(total AS DECIMAL(18,2)) || ', and subtotal and tax don''t explain it' END END AS message FROM v4 JOIN pt USING (k)"""
ORACLE["currency_check"] = f"WITH {BASE} SELECT CAST(k AS VARCHAR) AS document_id, 'currency ' || currency || ' isn''t one of EUR' AS message FROM v5 JOIN pd USING (k)"
ORACLE["decisions"] = f"WITH {BASE} SELECT CAST(k AS VARCHAR) AS document_id, requires_review, reasons, n_issues FROM dec"
ORACLE["review_reasons"] = f"WITH {BASE} SELECT reason, count(DISTINCT k) AS documents FROM va GROUP BY reason"

EVALUATION = BASE.replace("WITH ", "") + """,
sc AS (SELECT p.k, p.i AS p, g.i AS g, CASE WHEN p.has_d AND lower(p.descr) = lower(g.descr) THEN 2 ELSE 0 END + CASE WHEN p.has_t AND p.lt = g.lt THEN 2 ELSE 0 END + CASE WHEN p.has_q AND p.q = g.q THEN 1 ELSE 0 END + CASE WHEN p.u = g.u THEN 1 ELSE 0 END AS score
    FROM pi p JOIN gi g USING (k)),
so AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, p, g) AS n FROM sc WHERE score > 0),
ma AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS gs, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS g FROM gd
    UNION ALL SELECT so.k, so.n, CASE WHEN f THEN list_append(ps, so.p) ELSE ps END, CASE WHEN f THEN list_append(gs, so.g) ELSE gs END, CASE WHEN f THEN so.p END, CASE WHEN f THEN so.g END
      FROM ma JOIN so ON so.k = ma.k AND so.n = ma.n + 1, LATERAL (SELECT NOT list_contains(ps, so.p) AND NOT list_contains(gs, so.g) AS f) AS t),
mm AS (SELECT k, p, g FROM ma WHERE p IS NOT NULL),
mc AS (SELECT k, count(*) AS matched, bool_and(has_d AND has_t AND has_q AND lower(pi.descr) = lower(gi.descr) AND pi.lt = gi.lt AND pi.q = gi.q AND pi.u = gi.u) AS alike FROM mm JOIN pi ON pi.k = mm.k AND pi.i = mm.p JOIN gi ON gi.k = mm.k AND gi.i = mm.g GROUP BY ALL),
ev AS (SELECT pt.k, pt.n AS np, (SELECT count(*) FROM gi WHERE gi.k = pt.k) AS ng, coalesce(matched, 0) AS m, coalesce(alike, true) AS alike, pt.subtotal = gd.subtotal AS c_subtotal, pt.tax IS NOT DISTINCT FROM gd.tax AS c_tax,
      coalesce(total_status = 'extracted' AND total = gd.subtotal + coalesce(gd.tax, 0), false) AS c_total, coalesce(lower(currency) = 'eur', false) AS c_currency, coalesce(currency = 'EUR', false) AS e_currency, requires_review,
      EXISTS (SELECT 1 FROM v3 WHERE v3.k = pt.k) OR EXISTS (SELECT 1 FROM v4 WHERE v4.k = pt.k) AS arithmetic
    FROM pt JOIN gd USING (k) JOIN dec USING (k) LEFT JOIN mc USING (k)),
es AS (SELECT *, CASE WHEN np > 0 THEN m / np END AS precision, CASE WHEN ng > 0 THEN m / ng END AS recall FROM ev),
ef AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
    alike AND c_subtotal AND c_tax AND c_total AND c_currency AND coalesce(precision, 1) = 1 AND coalesce(recall, 1) = 1 AS fully_correct FROM es)"""
EVALUATION = EVALUATION.replace("mc AS (SELECT k,", "mc AS (SELECT mm.k,").replace("GROUP BY ALL", "GROUP BY mm.k")
ORACLE["item_pair_scores"] = f"WITH RECURSIVE {EVALUATION} SELECT CAST(k AS VARCHAR) AS document_id, p, g, CAST(score AS BIGINT) AS score FROM sc WHERE score > 0"
ORACLE["item_matching"] = f"WITH RECURSIVE {EVALUATION} SELECT CAST(k AS VARCHAR) AS document_id, p, g FROM mm"
ORACLE["pr_f1"] = f"WITH RECURSIVE {EVALUATION} SELECT CAST(k AS VARCHAR) AS document_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, fully_correct FROM ef"
ORACLE["field_accuracy"] = f"WITH RECURSIVE {EVALUATION} " + " UNION ALL ".join(f"SELECT '{n}' AS field_path, count(*) AS evaluable, round(avg(CAST(c_{n} AS INT)), 9) AS accuracy, round(avg(CAST({'e' if n == 'currency' else 'c'}_{n} AS INT)), 9) AS exact_match_rate FROM ef" for n in ("subtotal", "tax", "total", "currency"))
_RATES = ", ".join(f"round(avg(CAST({'e' if n == 'currency' and s == 'exact' else 'c'}_{n} AS INT)), 9) AS {n}_{s}" for s in ("accuracy", "exact") for n in ("subtotal", "tax", "total", "currency"))
ORACLE["evaluation_report"] = f"""WITH RECURSIVE {EVALUATION} SELECT count(*) AS documents, {_RATES}, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1,
  round(avg(CAST(NOT arithmetic AS INT)), 9) AS arithmetic_consistency_rate, round(avg(CAST(NOT requires_review AS INT)), 9) AS coverage, round(avg(CAST(NOT fully_correct AS INT)) FILTER (WHERE NOT requires_review), 9) AS false_accept_rate FROM ef"""

LINES = BASE + """,
rl AS (SELECT k, i AS idx, CASE WHEN i % 2 = 0 THEN descr || ' ' || CAST(q AS INT) || ' x ' || replace(CAST(u AS VARCHAR), '.', ',') || ' ' || replace(CAST(lt AS VARCHAR), '.', ',') ELSE descr || '  ' || replace(CAST(lt AS VARCHAR), '.', ',') END AS line FROM gi
  UNION ALL SELECT k, 1000, 'Zwischensumme ' || replace(CAST(subtotal AS VARCHAR), '.', ',') FROM gd UNION ALL SELECT k, 1001, 'MwSt 19% ' || replace(CAST(tax AS VARCHAR), '.', ',') FROM gd WHERE tax IS NOT NULL
  UNION ALL SELECT k, 1002, 'Gesamt ' || replace(CAST(CAST(subtotal + coalesce(tax, 0) AS DECIMAL(18,2)) AS VARCHAR), '.', ',') FROM gd UNION ALL SELECT k, 1003, 'Gesamt 99,99' FROM gd WHERE k % 7 = 0
  UNION ALL SELECT k, 1004, 'Karte  usd  angenommen' FROM gd WHERE k % 5 = 0 UNION ALL SELECT k, 1005, CASE k % 3 WHEN 0 THEN '  in  EUR bezahlt ' ELSE 'in   € bezahlt' END FROM gd WHERE k % 3 < 2 UNION ALL SELECT k, 1006, '   ' FROM gd),
tl AS (SELECT k, idx, line, trim(regexp_replace(line, ' +', ' ', 'g')) AS text FROM rl WHERE trim(line) <> ''),
ta AS (SELECT *, TRY_CAST(replace(regexp_extract(text, '(-?[0-9][0-9.,]*)$', 1), ',', '.') AS DOUBLE) AS amount FROM tl),
tf AS (SELECT *, amount IS NOT NULL AND regexp_matches(lower(text), 'zwischensumme|subtotal|netto') AS s, amount IS NOT NULL AND regexp_matches(lower(text), 'mwst|ust|steuer|tax|vat') AS t,
  amount IS NOT NULL AND regexp_matches(lower(text), 'gesamtbetrag|endbetrag|gesamt|total|zu zahlen') AS g FROM ta),
f1 AS (SELECT k, min(idx) FILTER (WHERE s) AS si FROM tf GROUP BY k), f2 AS (SELECT tf.k, any_value(si) AS si, min(idx) FILTER (WHERE t AND idx IS DISTINCT FROM si) AS ti FROM tf JOIN f1 USING (k) GROUP BY tf.k),
f3 AS (SELECT tf.k, any_value(si) AS si, any_value(ti) AS ti, min(idx) FILTER (WHERE g AND idx IS DISTINCT FROM si AND idx IS DISTINCT FROM ti) AS gi FROM tf JOIN f2 USING (k) GROUP BY tf.k),
it AS (SELECT tf.k, row_number() OVER (PARTITION BY tf.k ORDER BY idx) - 1 AS idx, text, amount, regexp_extract(text, '^(.+?) ([0-9]+) x ([0-9,]+) ([0-9,]+)$', ['d', 'q', 'u', 't']) AS x FROM tf JOIN f3 USING (k)
  WHERE amount IS NOT NULL AND idx IS DISTINCT FROM si AND idx IS DISTINCT FROM ti AND idx IS DISTINCT FROM gi)"""
ORACLE["baseline_slots"] = f"""WITH {LINES} SELECT CAST(f3.k AS VARCHAR) AS document_id, a.amount AS subtotal, b.amount AS tax, c.amount AS total, (SELECT count(*) FROM it WHERE it.k = f3.k) AS n_items
  FROM f3 LEFT JOIN tf a ON a.k = f3.k AND a.idx = si LEFT JOIN tf b ON b.k = f3.k AND b.idx = ti LEFT JOIN tf c ON c.k = f3.k AND c.idx = gi"""
ORACLE["baseline_items"] = f"""WITH {LINES} SELECT CAST(k AS VARCHAR) AS document_id, idx, CASE WHEN x.q <> '' THEN x.d ELSE regexp_extract(text, '^(.+?) +[0-9,]+$', 1) END AS description,
  TRY_CAST(x.q AS DOUBLE) AS quantity, TRY_CAST(replace(x.u, ',', '.') AS DOUBLE) AS unit_price, amount AS line_total FROM it"""
ORACLE["currency_detect"] = rf"""WITH {LINES}, sy AS (SELECT k, idx, line, CASE WHEN contains(line, '€') THEN 'EUR' WHEN contains(line, '$') THEN 'USD' WHEN contains(line, '£') THEN 'GBP' END AS symbol, nullif(regexp_extract(upper(line), '\b(EUR|USD|GBP|CHF)\b'), '') AS code FROM tl),
fi AS (SELECT k, min(idx) FILTER (WHERE symbol IS NOT NULL) AS si, min(idx) FILTER (WHERE code IS NOT NULL) AS ci FROM sy GROUP BY k)
SELECT CAST(fi.k AS VARCHAR) AS document_id, CASE WHEN si IS NULL THEN code ELSE symbol END AS currency, line AS raw_text FROM fi LEFT JOIN sy ON sy.k = fi.k AND sy.idx = coalesce(si, ci)"""
# Words run into the line of the first word within 10 pixels above; each step of the recursion places one more word of every page.
ORACLE["ocr_lines"] = f"""WITH RECURSIVE {BASE}, pw AS (SELECT k, CASE WHEN k % 4 = 1 THEN 6 ELSE 20 END * i AS y, i, descr, lt FROM gi),
w AS (SELECT k, y + k % 7 AS top, 200 AS lft, 4 * i AS word_idx, replace(CAST(lt AS VARCHAR), '.', ',') AS text, 80 + k % 10 AS conf FROM pw UNION ALL SELECT k, y + i % 5, 10, 4 * i + 1, ' ' || replace(descr, ' ', '  ') || chr(9), 90 FROM pw
  UNION ALL SELECT k, y, 5, 4 * i + 2, '  ', 99 FROM pw UNION ALL SELECT k, y, 400, 4 * i + 3, '?', -1 FROM pw),
o AS (SELECT k, top, lft, trim(text, ' ' || chr(9)) AS text, conf, row_number() OVER (PARTITION BY k ORDER BY top, lft, word_idx) AS n FROM w WHERE trim(text, ' ' || chr(9)) <> '' AND conf >= 0),
pl AS (SELECT k, n, top AS anchor FROM o WHERE n = 1 UNION ALL SELECT o.k, o.n, CASE WHEN abs(o.top - anchor) <= 10 THEN anchor ELSE o.top END FROM pl JOIN o ON o.k = pl.k AND o.n = pl.n + 1)
SELECT CAST(k AS VARCHAR) AS document_id, dense_rank() OVER (PARTITION BY k ORDER BY anchor) - 1 AS line_idx, string_agg(text, ' ' ORDER BY lft, n) AS text, avg(CAST(conf AS DOUBLE)) AS confidence FROM pl JOIN o USING (k, n) GROUP BY k, anchor"""
# The answers are made as the fixture makes them; from there on, their JSON is parsed.
_ANSWER = """'{"status":"' || {status} || '","value":' || coalesce('"' || {value} || '"', 'null') || '}'"""
_SAY = lambda status, value: _ANSWER.replace("{status}", status).replace("{value}", value)
_COMMA = lambda x: f"replace(CAST({x} AS VARCHAR), '.', ',')"
MODEL = BASE + rf""",
mt AS (SELECT k, CASE WHEN k % 19 = 1 THEN 'sorry' ELSE '{{"line_items":' || CASE WHEN k % 19 = 6 THEN '7' ELSE '[' || listed || ']' END || ',"subtotal":' || {_SAY("'extracted'", _COMMA("subtotal"))} || ',"tax":' || {_SAY("CASE WHEN tax IS NULL THEN 'not_present' ELSE 'extracted' END", _COMMA("tax"))}
    || ',"total":' || {_SAY("CASE k % 19 WHEN 0 THEN 'guessed' WHEN 5 THEN 'unreadable' ELSE 'extracted' END", "CASE k % 19 WHEN 4 THEN 'n/a' WHEN 5 THEN NULL ELSE " + _COMMA("CAST(subtotal + coalesce(tax, 0) AS DECIMAL(18,2))") + " END")}
    || ',"currency":' || {_SAY("'extracted'", "CASE k % 19 WHEN 2 THEN ' eur ' WHEN 3 THEN '€' ELSE 'EUR' END")} || '}}' END AS t
  FROM gd JOIN (SELECT k, string_agg('{{"description":' || {_SAY("'extracted'", "descr")} || ',"quantity":{{"status":"not_present","value":null}},"unit_price":' || {_SAY("'uncertain'", _COMMA("u"))} || ',"line_total":' || {_SAY("'extracted'", _COMMA("lt"))} || '}}', ',' ORDER BY i) AS listed FROM gi GROUP BY k) USING (k)),
mj AS (SELECT k, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM mt),
ml AS (SELECT k, j, CASE WHEN json_type(j, '$.line_items') = 'ARRAY' THEN CAST(j -> '$.line_items' AS JSON[]) END AS items FROM mj),
mi AS (SELECT k, unnest(items) AS x, unnest(range(len(items))) AS i FROM ml),
mf AS (SELECT k, i, ord, 'line_items[' || i || '].' || name AS path, x -> name AS f FROM mi, (VALUES (0, 'description'), (1, 'quantity'), (2, 'unit_price'), (3, 'line_total')) AS n(ord, name)
  UNION ALL SELECT k, 1000000, ord, name, j -> name FROM ml, (VALUES (0, 'subtotal'), (1, 'tax'), (2, 'total'), (3, 'currency')) AS n(ord, name)),
ms AS (SELECT *, f ->> '$.status' AS status, CASE WHEN json_type(f, '$.value') = 'VARCHAR' AND trim(f ->> '$.value') <> '' THEN f ->> '$.value' END AS raw FROM mf),
mw AS (SELECT k, arg_min(path || CASE WHEN json_type(f) = 'OBJECT' THEN '.status unknown' ELSE ' not an object' END, i * 10 + ord) AS bad FROM ms WHERE json_type(f) IS DISTINCT FROM 'OBJECT' OR status IS NULL OR status NOT IN ('extracted', 'not_present', 'uncertain', 'unreadable') GROUP BY k),
me AS (SELECT k, items, CASE WHEN j IS NULL THEN 'invalid_json' WHEN json_type(j) <> 'OBJECT' THEN 'root not an object' WHEN items IS NULL THEN 'line_items not a list' ELSE bad END AS error FROM ml LEFT JOIN mw USING (k)),
mp AS (SELECT *, regexp_extract(raw, '[-+]?[0-9][0-9.,]*') AS token, upper(trim(raw)) AS code FROM ms JOIN me USING (k) WHERE error IS NULL AND i = 1000000),
mn AS (SELECT *, TRY_CAST(CASE WHEN contains(token, ',') AND contains(token, '.') THEN CASE WHEN instr(reverse(token), ',') < instr(reverse(token), '.') THEN replace(replace(token, '.', ''), ',', '.') ELSE replace(token, ',', '') END
    WHEN contains(token, ',') THEN replace(token, ',', '.') WHEN instr(reverse(token), '.') = 4 THEN replace(token, '.', '') ELSE token END AS DOUBLE) AS number FROM mp),
mr AS (SELECT k, path, CASE WHEN status IN ('not_present', 'unreadable') THEN status WHEN raw IS NULL OR path <> 'currency' AND number IS NULL OR path = 'currency' AND status = 'extracted' AND NOT regexp_matches(code, '^\p{{L}}{{3}}$') THEN 'uncertain' ELSE status END AS state,
    CASE WHEN status NOT IN ('not_present', 'unreadable') THEN raw END AS raw, number, CASE WHEN status <> 'extracted' THEN trim(raw) WHEN regexp_matches(code, '^\p{{L}}{{3}}$') THEN code END AS code FROM mn)"""
_PICK = lambda what, name: f"any_value({what}) FILTER (WHERE path = '{name}')"
ORACLE["model_json_adapt"] = f"""WITH {MODEL} SELECT CAST(me.k AS VARCHAR) AS document_id, any_value(error) AS error, CASE WHEN any_value(error) IS NULL THEN any_value(len(items)) END AS n_items, {_PICK("state", "tax")} AS tax_status, {_PICK("number", "tax")} AS tax,
  {_PICK("state", "total")} AS total_status, {_PICK("number", "total")} AS total, {_PICK("raw", "total")} AS total_raw, {_PICK("state", "currency")} AS currency_status, {_PICK("code", "currency")} AS currency, {_PICK("raw", "currency")} AS currency_raw FROM me LEFT JOIN mr USING (k) GROUP BY me.k"""
ORACLE["ocr_columns"] = ORACLE["ocr_lines"]
ORACLE["image_lines"] = f"""WITH lines AS ({ORACLE["ocr_lines"]}), pages AS (SELECT k, k // 200 AS file, row_number() OVER (PARTITION BY k // 200 ORDER BY k) - 1 AS page FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey))
SELECT file, page, row_number() OVER (PARTITION BY file ORDER BY page, line_idx) - 1 AS line_idx, text, confidence, NULL AS error FROM lines JOIN pages ON document_id = CAST(k AS VARCHAR) WHERE k % 13 <> 0
UNION ALL SELECT file, page, NULL, NULL, NULL, 'ValueError: no image' FROM pages WHERE k % 13 = 0 UNION ALL SELECT file, count(*), NULL, NULL, NULL, 'OSError: cut off' FROM pages WHERE file % 7 = 3 GROUP BY file"""
ORACLE["unmatched_documents"] = f"""WITH {BASE}, p AS (SELECT CAST(k AS VARCHAR) AS document_id FROM pd WHERE k % 11 <> 0), g AS (SELECT CAST(k AS VARCHAR) AS document_id FROM gd WHERE k % 7 <> 0)
SELECT document_id, CASE WHEN g.document_id IS NULL THEN 'predicted' ELSE 'truth' END AS side FROM p FULL JOIN g USING (document_id) WHERE p.document_id IS NULL OR g.document_id IS NULL"""
_BARE = lambda value, status, confidence="'null'": f"""'{{"value":' || coalesce('"' || {value} || '"', 'null') || ',"raw_text":null,"status":"' || {status} || '","confidence":' || {confidence} || ',"evidence":[]}}'"""
_CENTS = lambda x: f"CAST({x} AS DECIMAL(18,2))"
_HAS = lambda x: f"CASE WHEN {x} THEN 'extracted' ELSE 'not_present' END"
ORACLE["receipt_json"] = f"""WITH {BASE}, ji AS (SELECT k, string_agg('{{"description":' || {_BARE("descr", "CASE WHEN doubt THEN 'uncertain' ELSE 'extracted' END")} || ',"quantity":' || {_BARE(f"CASE WHEN has_q THEN {_CENTS('q')} END", _HAS("has_q"))} || ',"unit_price":' || {_BARE(_CENTS("u"), "'extracted'")}
    || ',"line_total":' || {_BARE(f"CASE WHEN has_t THEN {_CENTS('lt')} END", _HAS("has_t"))} || '}}', ',' ORDER BY i) AS listed FROM pi GROUP BY k)
SELECT CAST(k AS VARCHAR) AS document_id, '{{"schema_version":"0.1.0","document_id":"' || k || '","line_items":[' || coalesce(listed, '') || '],"subtotal":' || {_BARE(_CENTS("subtotal"), "'extracted'")} || ',"tax":' || {_BARE(_CENTS("tax"), _HAS("tax IS NOT NULL"))}
  || ',"total":' || {_BARE(_CENTS("total"), "total_status", "CASE WHEN low THEN '0.3' ELSE 'null' END")} || ',"currency":' || {_BARE("currency", _HAS("currency IS NOT NULL"))} || '}}' AS json FROM pd LEFT JOIN ji USING (k)"""
ORACLE["model_calls"] = f"""WITH {BASE}, t AS (SELECT k, CAST(subtotal + coalesce(tax, 0) AS DECIMAL(18,2)) AS total FROM gd), d AS (SELECT *, CAST(total * 100 AS BIGINT) % 11 AS d FROM t),
e AS (SELECT *, CASE d WHEN 0 THEN 'http 429: quota used up' WHEN 1 THEN 'http 502: "bad gateway"' WHEN 2 THEN 'no candidates' WHEN 3 THEN 'empty answer' WHEN 4 THEN 'answer not JSON' WHEN 5 THEN 'answer not an object' WHEN 6 THEN 'total.status unknown' END AS error FROM d),
i AS (SELECT k, count(*) AS n, string_agg(descr, '|' ORDER BY i) AS names, round(sum(CAST(CAST(q AS INTEGER) AS DOUBLE)), 2) AS q, round(sum(CAST(u AS DOUBLE)), 2) AS u, round(sum(CAST(lt AS DOUBLE)), 2) AS t FROM gi WHERE i % 2 = 0 GROUP BY k),
g AS (SELECT e.k, error, error IS NULL AS ok, total, i.* EXCLUDE k FROM e JOIN i USING (k))
SELECT CAST(k AS VARCHAR) AS document_id, error, CASE WHEN ok THEN n END AS n_items, CASE WHEN ok THEN names END AS names, CASE WHEN ok THEN q END AS summed_quantity, CASE WHEN ok THEN u END AS summed_unit_price, CASE WHEN ok THEN t END AS summed_line_total,
  CASE WHEN ok THEN n END AS doubtful, CASE WHEN ok THEN 'extracted' END AS total_status, CASE WHEN ok THEN CAST(total AS DOUBLE) END AS total, CASE WHEN ok THEN 'EUR' END AS currency FROM g"""
# Fields are changed as the query changes them; then each constraint is a rule over all fields.
ORACLE["receipt_faults"] = f"""WITH {BASE}, pf AS (SELECT k, 'subtotal' AS path, CASE WHEN k % 11 = 4 THEN 'not_present' ELSE 'extracted' END AS status, CAST(subtotal AS VARCHAR) AS value, NULL AS confidence FROM pd
  UNION ALL SELECT k, 'tax', CASE WHEN tax IS NULL THEN 'not_present' ELSE 'extracted' END, CASE WHEN k % 9 <> 2 THEN CAST(tax AS VARCHAR) END, NULL FROM pd
  UNION ALL SELECT k, 'total', CASE WHEN k % 13 = 5 THEN 'guessed' ELSE total_status END, CAST(total AS VARCHAR), CASE WHEN k % 7 = 3 THEN 1.5 WHEN low THEN 0.3 END FROM pd
  UNION ALL SELECT k, 'currency', CASE WHEN currency IS NULL THEN 'not_present' ELSE 'extracted' END, CASE WHEN k % 5 = 0 THEN lower(currency) ELSE currency END, NULL FROM pd
  UNION ALL SELECT k, 'line_items[' || i || '].description', CASE WHEN doubt THEN 'uncertain' ELSE 'extracted' END, descr, NULL FROM pi
  UNION ALL SELECT k, 'line_items[' || i || '].quantity', CASE WHEN has_q AND NOT (k % 3 = 1 AND i = 0) THEN 'extracted' ELSE 'not_present' END, CASE WHEN has_q THEN CAST(q AS VARCHAR) END, NULL FROM pi
  UNION ALL SELECT k, 'line_items[' || i || '].unit_price', 'extracted', CAST(u AS VARCHAR), NULL FROM pi
  UNION ALL SELECT k, 'line_items[' || i || '].line_total', CASE WHEN has_t THEN 'extracted' ELSE 'not_present' END, CASE WHEN has_t THEN CAST(lt AS VARCHAR) END, NULL FROM pi)
SELECT k, path || ': ' || unnest(list_filter([CASE WHEN status NOT IN ('extracted', 'not_present', 'uncertain', 'unreadable', 'not_annotated') THEN 'unknown status' END, CASE WHEN status = 'extracted' AND value IS NULL THEN 'extracted without a value' END,
    CASE WHEN status IN ('not_present', 'unreadable', 'not_annotated') AND value IS NOT NULL THEN 'a value where the status says there is none' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence outside 0 to 1' END,
    CASE WHEN path = 'currency' AND status = 'extracted' AND NOT regexp_matches(value, '^[A-Z]{{3}}$') THEN 'not a code' END], lambda x: x IS NOT NULL)) AS fault FROM pf
UNION ALL SELECT k, 'document_id: empty' FROM pd WHERE k % 17 = 6 UNION ALL SELECT k, 'schema_version: unknown' FROM pd WHERE k % 19 = 1"""

# The canonical texts are receipt_json's, broken as the query breaks them; from there on they are parsed, key by key.
CANONICAL = r"""ca AS (SELECT document_id AS id, CASE CAST(document_id AS BIGINT) % 23 WHEN 0 THEN substr(json, 2) WHEN 1 THEN replace(json, '"currency":', '"curency":') WHEN 2 THEN '{"more":1,' || substr(json, 2) WHEN 3 THEN replace(json, '"0.1.0"', '"9"')
    WHEN 4 THEN replace(json, '"status":"extracted"', '"status":"guessed"') WHEN 5 THEN replace(json, '"schema_version":"0.1.0",', '') WHEN 6 THEN '[]' WHEN 7 THEN regexp_replace(json, '"document_id":"[0-9]+"', '"document_id":5')
    WHEN 8 THEN replace(json, '"confidence":null', '"confidence":1.5') WHEN 9 THEN replace(json, '"raw_text":null', '"raw_text":3') WHEN 10 THEN replace(json, '"status":"not_present",', '') WHEN 11 THEN replace(json, '"evidence":[]', '"evidence":[{"text":"a","page":0}]')
    WHEN 12 THEN replace(json, '"evidence":[]', '"evidence":[{"text":"a","page":1}]') WHEN 13 THEN replace(json, '"quantity":', '"qty":') WHEN 14 THEN regexp_replace(json, '"value":"([0-9.]+)"', '"value":\1', 'g') WHEN 15 THEN replace(json, '"value":null', '"value":"1"') ELSE json END AS raw FROM made),
cj AS (SELECT id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM ca),
cd AS (SELECT id, j, coalesce(json_type(j) = 'OBJECT', false) AS is_object, coalesce(json_keys(j), []) AS keys, CASE json_type(j, '$.line_items') WHEN 'ARRAY' THEN CAST(j -> '$.line_items' AS JSON[]) ELSE [] END AS items FROM cj),
ci AS (SELECT id, unnest(items) AS x FROM cd),
cf AS (SELECT id, name, j -> name AS v FROM cd, (VALUES ('subtotal'), ('tax'), ('total'), ('currency')) AS n(name) WHERE is_object UNION ALL SELECT id, name, x -> name FROM ci, (VALUES ('description'), ('quantity'), ('unit_price'), ('line_total')) AS n(name)),
cv AS (SELECT *, v ->> 'status' AS status, coalesce(json_type(v -> 'value'), 'NULL') AS kind, v ->> 'value' AS value, v -> 'confidence' AS conf, CASE coalesce(json_type(v -> 'evidence'), 'NULL') WHEN 'ARRAY' THEN CAST(v -> 'evidence' AS JSON[]) END AS said FROM cf),
cg AS (SELECT id, bool_and(coalesce(json_type(v) = 'OBJECT' AND len(list_filter(json_keys(v), lambda y: y NOT IN ('value', 'raw_text', 'status', 'confidence', 'evidence'))) = 0 AND status IN ('extracted', 'not_present', 'uncertain', 'unreadable', 'not_annotated')
    AND CASE WHEN kind = 'NULL' THEN status <> 'extracted' WHEN status IN ('not_present', 'unreadable', 'not_annotated') THEN false WHEN name IN ('description', 'currency') THEN kind = 'VARCHAR' ELSE TRY_CAST(value AS DECIMAL(18, 6)) IS NOT NULL END
    AND (name <> 'currency' OR status <> 'extracted' OR regexp_matches(value, '^[A-Z]{3}$')) AND coalesce(json_type(v -> 'raw_text'), 'NULL') IN ('NULL', 'VARCHAR') AND (coalesce(json_type(conf), 'NULL') = 'NULL' OR TRY_CAST(CAST(conf AS VARCHAR) AS DOUBLE) BETWEEN 0 AND 1)
    AND (coalesce(json_type(v -> 'evidence'), 'NULL') = 'NULL' OR (said IS NOT NULL AND len(list_filter(said, lambda e: NOT coalesce(json_type(e -> 'text') = 'VARCHAR' AND e ->> 'text' <> '' AND coalesce(CAST(e ->> 'page' AS INT), 1) >= 1, false))) = 0)), false)) AS ok FROM cv GROUP BY id),
cw AS (SELECT id, bool_and(coalesce(list_sort(json_keys(x)) = ['description', 'line_total', 'quantity', 'unit_price'], false)) AS ok FROM ci GROUP BY id),
cr AS (SELECT cd.id, coalesce(is_object AND len(list_filter(keys, lambda y: y NOT IN ('schema_version', 'document_id', 'line_items', 'subtotal', 'tax', 'total', 'currency'))) = 0 AND list_has_all(keys, ['document_id', 'subtotal', 'tax', 'total', 'currency']) AND json_type(j, '$.document_id') = 'VARCHAR' AND j ->> '$.document_id' <> ''
    AND (json_type(j, '$.schema_version') IS NULL OR j ->> '$.schema_version' = '0.1.0') AND coalesce(json_type(j, '$.line_items'), 'ARRAY') = 'ARRAY' AND cg.ok AND coalesce(cw.ok, true), false) AS ok, j, len(items) AS n FROM cd LEFT JOIN cg USING (id) LEFT JOIN cw USING (id))"""
CANONICAL = f"made AS ({ORACLE['receipt_json']}), {CANONICAL}"
ORACLE["schema_valid"] = f"WITH {CANONICAL} SELECT id, ok AS schema_valid, CASE WHEN ok THEN j ->> '$.document_id' END AS document_id, CASE WHEN ok THEN n END AS n_items, CASE WHEN ok THEN CAST(j ->> '$.total.value' AS DOUBLE) END AS total FROM cr"
ORACLE["schema_valid_rate"] = f"WITH {CANONICAL} SELECT count(*) AS documents, count(*) FILTER (WHERE ok) AS valid, round(avg(CAST(ok AS INT)), 9) AS rate FROM cr"

# The annotation texts are made as the fixture makes them; from there on, JSON is parsed and nothing of how it was made is used.
PROFILE = BASE + r""",
an AS (SELECT k, CASE k % 29 WHEN 0 THEN '{invalid' WHEN 1 THEN '{"gt_parse":5}' ELSE '{"gt_parse":{"menu":' || CASE WHEN n = 1 THEN listed ELSE '[' || listed || ']' END || ',"sub_total":'
    || CASE WHEN k % 29 = 3 THEN '[{"subtotal_price":"1"}]' ELSE '{"subtotal_price":' || CASE k % 29 WHEN 4 THEN '["' || subtotal || '","' || subtotal || '"]' WHEN 5 THEN '["' || subtotal || '","7"]' WHEN 6 THEN '"-"' ELSE '"' || subtotal || '"' END
      || coalesce(',"tax_price":"' || tax || '"', '') || '}' END
    || ',"total":{"total_price":' || CASE WHEN k % 29 = 8 THEN '"10%"' WHEN k % 29 = 9 THEN '7' ELSE '"' || CAST(subtotal + coalesce(tax, 0) AS DECIMAL(18,2)) || '"' END || '}},"meta":{"split":"' || CASE k % 10 WHEN 8 THEN 'valid' WHEN 9 THEN 'test' ELSE 'train' END || '"'
    || CASE WHEN k % 29 = 7 THEN '' ELSE ',"image_id":' || k END || '}}' END AS t
  FROM gd JOIN (SELECT k, count(*) AS n, string_agg('{"nm":"  ' || descr || '","cnt":"' || CAST(q AS INT) || ' x","unitprice":"Rp ' || u || '","price":' || CASE WHEN k % 29 = 2 AND i = 0 THEN '5' ELSE '"' || replace(CAST(lt AS VARCHAR), '.', ',') || '"' END || '}', ',' ORDER BY i) AS listed FROM gi GROUP BY k) USING (k)),
js AS (SELECT k, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM an),
jd AS (SELECT k, j, coalesce(json_type(j) = 'OBJECT', false) AS valid, coalesce(json_type(j, '$.gt_parse') = 'OBJECT', false) AS parsed, CASE WHEN json_type(j, '$.meta') = 'OBJECT' THEN coalesce(j ->> '$.meta.split', 'unknown') ELSE 'unknown' END AS split,
    j -> '$.gt_parse.menu' AS menu, j -> '$.gt_parse.sub_total' AS sub, j -> '$.gt_parse.total' AS tot, j ->> '$.meta.image_id' AS image FROM js),
jl AS (SELECT *, CASE json_type(menu) WHEN 'OBJECT' THEN [menu] WHEN 'ARRAY' THEN CAST(menu AS JSON[]) ELSE [] END AS items FROM jd),
ji AS (SELECT k, unnest(items) AS x, unnest(range(len(items))) AS i FROM jl WHERE parsed),
cells AS (SELECT k, -1 AS i, name, key, sub -> key AS v FROM jl, (VALUES ('subtotal', 'subtotal_price'), ('tax', 'tax_price'), ('discount', 'discount_price'), ('service_charge', 'service_price'), ('other_service_charge', 'othersvc_price'), ('subtotal_other', 'etc')) AS f(name, key) WHERE parsed AND json_type(sub) = 'OBJECT'
  UNION ALL SELECT k, -1, 'total', 'total_price', tot -> 'total_price' FROM jl WHERE parsed AND json_type(tot) = 'OBJECT'
  UNION ALL SELECT k, i, name, key, x -> key FROM ji, (VALUES ('description', 'nm'), ('quantity', 'cnt'), ('unit_price', 'unitprice'), ('line_total', 'price')) AS f(name, key)),
cs AS (SELECT *, v IS NOT NULL AND json_type(v) <> 'NULL' AND CAST(v AS VARCHAR) NOT IN ('""', '[]', '{}') AS present, coalesce(json_type(v) = 'VARCHAR', false) AS is_text, v ->> '$' AS txt,
    CASE json_type(v) WHEN 'VARCHAR' THEN [v ->> '$'] WHEN 'ARRAY' THEN CAST(v AS VARCHAR[]) END AS pieces,
    CASE WHEN i >= 0 THEN i * 4 + list_position(['nm', 'cnt', 'unitprice', 'price'], key) WHEN name IN ('subtotal', 'tax', 'total') THEN 1000000 + list_position(['subtotal', 'tax', 'total'], name) END AS ord FROM cells),
er AS (SELECT jl.k, CASE WHEN NOT valid THEN CASE WHEN j IS NULL THEN 'invalid_json' ELSE 'json_root_not_object' END WHEN NOT parsed THEN 'missing_or_invalid_gt_parse' WHEN image IS NULL THEN 'no document id' ELSE bad.error END AS error
  FROM jl LEFT JOIN (SELECT k, arg_min(CASE WHEN name = 'total' THEN 'total.' || key || ' not text' WHEN i < 0 THEN 'sub_total.' || key || ' not text' WHEN key = 'nm' THEN 'text field not text' ELSE 'menu[' || i || '].' || key || ' not text' END, ord) AS error FROM cs WHERE ord IS NOT NULL AND v IS NOT NULL AND pieces IS NULL GROUP BY k) AS bad USING (k)),
st AS (SELECT cs.*, list_filter(pieces, lambda x: trim(x) NOT IN ('', '-')) AS said, list_distinct(list_filter(list_transform(list_filter(pieces, lambda x: trim(x) NOT IN ('', '-') AND (name = 'quantity' OR NOT contains(x, '%')) AND regexp_matches(x, '[0-9]')),
    lambda x: CASE WHEN name = 'quantity' THEN CAST(replace(regexp_extract(x, '[-+]?[0-9]+([.,][0-9]+)?'), ',', '.') AS DOUBLE) ELSE CAST(translate(regexp_extract(x, '[-+]?[0-9][0-9.,]*'), '.,', '') AS DOUBLE) END), lambda y: name <> 'quantity' OR y > 0)) AS vals FROM cs JOIN er USING (k) WHERE error IS NULL),
status AS (SELECT k, i, name, CASE WHEN v IS NULL OR len(said) = 0 THEN 'not_present' WHEN name = 'description' OR len(vals) = 1 THEN 'extracted' ELSE 'not_annotated' END AS status, vals[1] AS value, array_to_string(pieces, ' | ') AS raw_text, array_to_string(list_transform(said, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), ' ') AS words FROM st WHERE name IN ('subtotal', 'tax', 'total') OR i >= 0
  UNION ALL SELECT k, -1, name, CASE json_type(sec) WHEN 'ARRAY' THEN 'not_annotated' ELSE 'not_present' END, NULL, CASE json_type(sec) WHEN 'ARRAY' THEN CAST(sec AS VARCHAR) END, NULL FROM (SELECT k, unnest(['subtotal', 'tax', 'total']) AS name, unnest([sub, sub, tot]) AS sec FROM jl JOIN er USING (k) WHERE error IS NULL) WHERE json_type(sec) IS DISTINCT FROM 'OBJECT'
  UNION ALL SELECT k, -1, 'currency', 'not_annotated', NULL, NULL, NULL FROM er WHERE error IS NULL),
forms AS (SELECT k, CASE WHEN name = 'quantity' THEN 'quantity' ELSE 'amount' END AS what, present, is_text, txt, lower(regexp_replace(txt, '\s', '', 'g')) AS tight FROM cs WHERE name NOT IN ('description', 'subtotal_other')),
en AS (SELECT 'documents' AS section, unnest(['total', CASE WHEN valid THEN 'valid_json' END, CASE WHEN error IS NULL THEN 'adapter_successes' ELSE 'adapter_errors' END]) AS key, NULL AS subkey, 1 AS n FROM jl JOIN er USING (k)
  UNION ALL SELECT 'documents', 'by_split', split, 1 FROM jl WHERE valid UNION ALL SELECT 'line_items', 'total', NULL, len(items) FROM jl WHERE parsed UNION ALL SELECT 'line_items', 'by_split', split, len(items) FROM jl WHERE parsed
  UNION ALL SELECT 'menu_shape', CASE json_type(menu) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' ELSE 'missing' END, NULL, 1 FROM jl WHERE parsed
  UNION ALL SELECT 'document_field_presence', 'line_items', NULL, 1 FROM jl WHERE parsed AND len(items) > 0 UNION ALL SELECT CASE WHEN i < 0 THEN 'document' ELSE 'line_item' END || '_field_presence', name, NULL, 1 FROM cs WHERE present
  UNION ALL SELECT 'adapter_error_details', error, NULL, 1 FROM er WHERE error IS NOT NULL UNION ALL SELECT CASE WHEN i < 0 THEN 'document' ELSE 'line_item' END || '_field_statuses', name, status, 1 FROM status
  UNION ALL SELECT 'normalization_errors', what || '_not_string', NULL, 1 FROM forms WHERE present AND NOT is_text UNION ALL SELECT 'normalization_errors', what || '_unparseable', NULL, 1 FROM forms WHERE present AND is_text AND NOT regexp_matches(txt, '[0-9]')
  UNION ALL SELECT 'amount_formats', CASE WHEN contains(txt, ',') AND contains(txt, '.') THEN 'mixed_separators' WHEN contains(txt, ',') THEN 'comma' WHEN contains(txt, '.') THEN 'dot' ELSE 'digits_only' END || CASE WHEN regexp_matches(txt, '[^0-9\s.,+-]') THEN '_with_affix' ELSE '_plain' END, NULL, 1 FROM forms WHERE what = 'amount' AND present AND is_text
  UNION ALL SELECT 'quantity_formats', CASE WHEN regexp_matches(tight, '^[0-9]+$') THEN 'integer' WHEN regexp_matches(tight, '^[0-9]+[.,][0-9]+$') THEN 'decimal' WHEN regexp_matches(tight, 'x[0-9]') THEN 'x_before_number' WHEN regexp_matches(tight, '[0-9]([.,][0-9]+)?x') THEN 'x_after_number' ELSE 'other' END, NULL, 1 FROM forms WHERE what = 'quantity' AND present AND is_text),
counted AS (SELECT section, key, subkey, CAST(sum(n) AS BIGINT) AS n FROM en WHERE key IS NOT NULL GROUP BY ALL)"""
ORACLE["profile_counts"] = f"""WITH {PROFILE} SELECT section, key, subkey, n, CASE section WHEN 'document_field_presence' THEN round_even(n / (SELECT n FROM counted WHERE section = 'documents' AND key = 'valid_json'), 4)
  WHEN 'line_item_field_presence' THEN round_even(n / (SELECT n FROM counted WHERE section = 'line_items' AND key = 'total'), 4) END AS rate FROM counted"""
ORACLE["annotation_errors"] = f"""WITH {PROFILE} SELECT k, CASE error WHEN 'missing_or_invalid_gt_parse' THEN 'gt_parse not an object' WHEN 'json_root_not_object' THEN 'root not an object' ELSE error END AS error FROM er WHERE error IS NOT NULL"""
ORACLE["annotation_adapt"] = f"""WITH {PROFILE}, it AS (SELECT k, count(*) AS n_items, string_agg(words, '|' ORDER BY i) FILTER (WHERE name = 'description' AND status = 'extracted') AS names, CASE WHEN bool_and(value IS NOT NULL) FILTER (WHERE name = 'line_total') THEN sum(value) FILTER (WHERE name = 'line_total') END AS summed,
  CASE WHEN bool_and(value IS NOT NULL) FILTER (WHERE name = 'quantity') THEN sum(value) FILTER (WHERE name = 'quantity') END AS quantities FROM status WHERE i >= 0 GROUP BY k),
dc AS (SELECT k, {", ".join(f"any_value({w}) FILTER (WHERE name = '{n}') AS {n}{s}" for n in ("subtotal", "tax", "total") for w, s in (("status", "_status"), ("CASE WHEN status = 'extracted' THEN value END", ""), ("raw_text", "_raw")))} FROM status WHERE i < 0 GROUP BY k)
SELECT k, 'cord-' || split || '-' || image AS document_id, len(items) AS n_items, coalesce(names, '') AS names, coalesce(summed, CASE WHEN len(items) = 0 THEN 0 END) AS summed, coalesce(quantities, CASE WHEN len(items) = 0 THEN 0 END) AS quantities, dc.* EXCLUDE (k)
  FROM jl JOIN er USING (k) JOIN dc USING (k) LEFT JOIN it USING (k) WHERE error IS NULL"""
ORACLE["profile_presence"] = f"SELECT section, key, n, rate FROM ({ORACLE['profile_counts']}) WHERE section IN ('document_field_presence', 'line_item_field_presence')"
ORACLE["profile_status"] = f"SELECT key, subkey, n FROM ({ORACLE['profile_counts']}) WHERE section IN ('document_field_statuses', 'line_item_field_statuses')"
ORACLE["profile_distribution"] = f"""WITH {PROFILE}, n AS (SELECT len(items) AS n FROM jl WHERE parsed)
SELECT min(n) AS min_items, max(n) AS max_items, CAST(quantile_disc(n, 0.95) AS BIGINT) AS p95_items, round_even(avg(n), 3) AS mean_items, median(n) AS median_items FROM n"""
ORACLE["error_examples_top50"] = f"""WITH {PROFILE}, odd AS (SELECT k, '"non_string_item_fields":[' || string_agg('{{"index":' || i || ',"field":"' || key || '","value":' || CAST(v AS VARCHAR) || '}}', ',' ORDER BY ord) || ']' AS part FROM cs WHERE i >= 0 AND v IS NOT NULL AND json_type(v) NOT IN ('NULL', 'VARCHAR') GROUP BY k),
un AS (SELECT k, '"' || CASE name WHEN 'total' THEN 'total' ELSE 'sub_total' END || '":{{' || string_agg('"' || key || '":' || CAST(v AS VARCHAR), ',' ORDER BY key) || '}}' AS part, name = 'total' AS last FROM cs WHERE i < 0 AND v IS NOT NULL AND key <> 'etc' AND (NOT is_text OR trim(txt) = '-') GROUP BY k, name = 'total', CASE name WHEN 'total' THEN 'total' ELSE 'sub_total' END)
SELECT er.k, 'cord-' || split || '-' || coalesce(image, 'unknown') AS document_id, error, '{{' || concat_ws(',', odd.part, s.part, t.part) || '}}' AS context
  FROM er JOIN jl USING (k) LEFT JOIN odd USING (k) LEFT JOIN un s ON s.k = er.k AND NOT s.last LEFT JOIN un t ON t.k = er.k AND t.last WHERE error IS NOT NULL AND parsed ORDER BY er.k LIMIT 50"""
_SEEN = "CASE k % 3 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END"  # deliveries in the manifest's order
ORACLE["profile_report"] = f"""WITH rows AS ({ORACLE['profile_counts']}), spread AS ({ORACLE['profile_distribution']}), examples AS ({ORACLE['error_examples_top50'].replace('ORDER BY er.k LIMIT 50', f"ORDER BY {_SEEN.replace('k %', 'er.k %')}, er.k LIMIT 50")}),
met AS (WITH {PROFILE} SELECT 'adapter_error_details' AS section, error AS key, k FROM er WHERE error IS NOT NULL UNION ALL SELECT 'normalization_errors', what || '_not_string', k FROM forms WHERE present AND NOT is_text UNION ALL SELECT 'normalization_errors', what || '_unparseable', k FROM forms WHERE present AND is_text AND NOT regexp_matches(txt, '[0-9]')),
ranked AS (SELECT section, key, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, min(({_SEEN}) * 1000000000000 + k)) - 1 AS place FROM met GROUP BY section, key),
ex AS (SELECT *, row_number() OVER (ORDER BY {_SEEN}, k) - 1 AS i FROM examples)
SELECT '/' || section || '/' || key || coalesce('/' || subkey, CASE WHEN rate IS NULL THEN '' ELSE '/count' END) AS path, CAST(n AS VARCHAR) AS value, place FROM rows LEFT JOIN ranked USING (section, key)
UNION ALL SELECT '/' || section || '/' || key || '/rate', CAST(rate AS VARCHAR), NULL FROM rows WHERE rate IS NOT NULL
UNION ALL SELECT '/line_items/per_document/' || unnest(['min', 'max', 'p95', 'mean', 'median']), unnest([CAST(min_items AS VARCHAR), CAST(max_items AS VARCHAR), CAST(p95_items AS VARCHAR), CAST(mean_items AS VARCHAR), CAST(median_items AS VARCHAR)]), NULL FROM spread
UNION ALL SELECT '/adapter_error_examples/' || i || '/' || unnest(['document_id', 'error', 'context']), unnest(['"' || document_id || '"', '"' || error || '"', context]), NULL FROM ex
UNION ALL SELECT '/source/' || unnest(['dataset', 'files', 'advertised_bytes', 'columns']), unnest(['"orders"', '3', '3003', '["ground_truth"]']), NULL"""
