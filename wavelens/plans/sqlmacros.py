"""DuckDB spellings of the column functions, used to write oracle SQL.

The regex classes are the same strings as in :mod:`wavelens.functions.text`
(RE2 reads the ``\\x{..}`` escapes too); DuckDB needs the ``'g'`` flag.
"""

from __future__ import annotations

from wavelens.functions.text import PUNCT_RE, WS_ENDS_RE, WS_MULTI_RE, WS_RUN_RE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower({x}), {q(PUNCT_RE)}, '', 'g'), "
            f"{q(WS_RUN_RE)}, ' ', 'g'))")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(WS_RUN_RE)}), lambda w: w <> '')"


def wer_words(x: str) -> str:
    squeezed = (f"regexp_replace(regexp_replace({x}, {q(WS_MULTI_RE)}, ' ', 'g'), "
                f"{q(WS_ENDS_RE)}, '', 'g')")
    return f"list_filter(string_split({squeezed}, ' '), lambda w: w <> '')"


def norm_words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def split_of(doc_id: str) -> str:
    return (f"CASE {doc_id} % 20 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' "
            f"ELSE 'train' END")


# Utterance view over documents, as the oracle sees it: duration and length
# come from n_chars (the Spark side reads them from the WAV header bytes).
UTTERANCES = (
    "(SELECT doc_id AS utt_id, doc_id AS row_num, text AS transcription, "
    "n_chars AS transcription_length, n_chars / 1000.0 AS audio_duration, n_chars AS frames, "
    f"{split_of('doc_id')} AS split, 'clips/' || doc_id || '.wav' AS path FROM documents)")
