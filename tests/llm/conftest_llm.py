"""Names shared by the tests of this folder."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "id string, raw string, h int, n int, label string, row int, key int, tag int, at int, block int, slot int, _row int, _kept int"
