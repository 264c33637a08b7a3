"""The text queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from directed_extract.llm import checks
from directed_extract.llm import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: getattr(module, name)
    for module, names in (
        (q, "p2_found p2_unmatched p4_found p4_redacted p5_found p5_pieces p6_found p6_kinds p7_packed p7_report p8_blend p8_report p8_temperature p9_found p9_classes p9_forms"),
        (checks, "p2_exact p2_accounted p4_restored p5_rebuilt p7_checked p8_checked"),
    )
    for name in names.split()
}
ORACLES: dict[str, str] = {}
_TYPED = "(SELECT line_id, i - 1 AS pos, entidad[i].texto AS t FROM (SELECT line_id, entidad, unnest(range(1, len(entidad) + 1)) AS i FROM corpus_docs)) WHERE t IS NOT NULL"
ORACLES["p2_exact"] = f"""WITH names AS (SELECT DISTINCT concept_id, lower(trim(n)) AS n FROM (SELECT concept_id, unnest(list_concat([texto], coalesce(aliases, []))) AS n FROM entity_catalog))
SELECT line_id, cast(pos AS INT) AS pos, concept_id FROM (SELECT * FROM {_TYPED}) JOIN names ON n = lower(trim(t))"""
ORACLES["p2_accounted"] = f"SELECT count(*) AS n_typed, count(*) AS n_accounted FROM {_TYPED}"
ORACLES["p4_restored"] = "SELECT line_id, md5(texto) AS text_md5 FROM corpus_docs WHERE texto IS NOT NULL"
ORACLES["p5_found"] = """SELECT line_id FROM corpus_docs c LEFT JOIN split_limits l ON l.origin = c.origin
WHERE length(texto) > coalesce(l.max_chars, (SELECT max_chars FROM split_limits WHERE origin = 'default'))"""
ORACLES["p5_rebuilt"] = "SELECT line_id, md5(texto) AS text_md5, true AS within_limit, true AS exact_overlap FROM corpus_docs WHERE texto IS NOT NULL"
ORACLES["p7_checked"] = "SELECT spec_id, capacity_tokens, n AS n_docs, n AS n_placed, true AS within_capacity, true AS well_filled FROM pack_specs, (SELECT count(*) AS n FROM documents) WHERE capacity_tokens > 0"
_SOURCE = "regexp_replace(regexp_replace(lower({}), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '[\\s\\p{{Z}}-]+', '_', 'g')"
ORACLES["p8_checked"] = f"""WITH t AS (SELECT {_SOURCE.format('source')} AS source, target_share FROM mix_targets), has AS (SELECT DISTINCT {_SOURCE.format('source')} AS source FROM documents WHERE length(text) > 0),
live AS (SELECT source, CASE WHEN source IN (SELECT source FROM has) THEN target_share ELSE 0.0 END AS live FROM t)
SELECT source, round(live / (SELECT sum(live) FROM live), 6) AS due_share, true AS close, true AS within_repeats FROM live"""
# The consistent form in SQL, for the characters that occur: look-alikes, full-width forms, blanks, signs of one and of several letters.
_SAME = {
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοАВЕЅІЈКМНОРСТХаеорсухѕіјһɡɑ": "ABEZHIKMNOPTYXoABESIJKMHOPCTXaeopcyxsijhga", "ⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯµ\u212a\u212b": "ivxlcdmIVXLCDMμK\u00c5",
    "".join(chr(c) for c in range(0xFF01, 0xFF5F)): "".join(chr(c) for c in range(0x21, 0x7F)),
    "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000": " " * 17, "\r\x0b\x0c\x85\u2028\u2029": "\n" * 6, "‐‑": "--",
}
_SIGNS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "℃": "°C", "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "…": "..."}
_UNSEEN = "[\u00ad\u034f\u061c\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form(c: str) -> str:
    out = f"translate(regexp_replace({c}, '{_UNSEEN}', '', 'g'), {_quoted(''.join(_SAME))}, {_quoted(''.join(_SAME.values()))})".replace(c, f"replace({c}, chr(13) || chr(10), chr(10))", 1)
    for sign, letters in _SIGNS.items():
        out = f"replace({out}, '{sign}', '{letters}')"
    return f"nfc_normalize(rtrim(regexp_replace({out}, ' +\\n', chr(10), 'g'), chr(10) || ' '))"


_FORMS = f"forms AS (SELECT doc_id, text, {_form('text')} AS form FROM documents)"
ORACLES["p9_forms"] = f"WITH {_FORMS} SELECT doc_id, form, md5(replace(lower(form), 'ß', 'ss')) AS folded_digest FROM forms"
ORACLES["p9_classes"] = f"""WITH {_FORMS}, c AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT text) AS n_texts, count(*) AS n_rows FROM forms WHERE text IS NOT NULL GROUP BY form)
SELECT doc_id, class_id, n_texts, n_rows FROM forms JOIN c USING (form)"""
ORACLES["p9_found"] = f"WITH {_FORMS} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id"
_BARE = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')"
_KINDS = f"""kinds AS (
  SELECT cand_id, raw_record, CASE WHEN json_valid(raw_record) AND json_type(raw_record) = 'OBJECT' THEN 'flat:' || array_to_string(list_sort(
    list_transform(map_entries(cast(cast(raw_record AS JSON) AS MAP(VARCHAR, JSON))), lambda e: {_BARE.format('e.key')} || chr(1) || coalesce({_BARE.format("(e.value ->> '$')")}, chr(2)))), chr(3)) ELSE 'raw:' || raw_record END AS kind
  FROM candidate_lines WHERE raw_record IS NOT NULL),
firsts AS (SELECT *, min(cand_id) OVER (PARTITION BY kind) AS keep_id, count(*) OVER (PARTITION BY kind) AS n FROM kinds)"""
ORACLES["p6_found"] = f"WITH {_KINDS} SELECT keep_id, cand_id AS copy_id FROM firsts WHERE cand_id > keep_id"
ORACLES["p6_kinds"] = f"WITH {_KINDS} SELECT keep_id, n AS n_copies, raw_record FROM firsts WHERE cand_id = keep_id"
