"""Schemas of the logical tables, as DDL."""

CLAIM = (
    "claim_id LONG, claim STRING, speaker STRING, claim_date STRING, check_date STRING, reporting_source STRING, label STRING, "
    "justification STRING, claim_types ARRAY<STRING>, questions ARRAY<STRUCT<question STRING, answers ARRAY<STRUCT<answer STRING, "
    "answer_type STRING, boolean_explanation STRING, source_url STRING, source_medium STRING, cached_source_url STRING>>>>"
)
STORE = "claim_id LONG, type STRING, query STRING, url STRING, url2text ARRAY<STRING>"
SEARCH_LOG = "index LONG, claim STRING, link STRING, page INT, search_string STRING, search_type STRING, store_file STRING"
TOP_SENTENCES = "claim_id LONG, claim STRING, top_k ARRAY<STRUCT<sentence STRING, url STRING, rank INT>>"
TRIPLES = "claim_id LONG, claim STRING, bm25_qau ARRAY<STRUCT<question STRING, answer STRING, url STRING>>"
EVIDENCE = "claim_id LONG, claim STRING, evidence ARRAY<STRUCT<question STRING, answer STRING, url STRING, scraped_text STRING>>"
PREDICTION = EVIDENCE + ", pred_label STRING"
GENERATION = "claim_id LONG, claim STRING, generation ARRAY<STRING>, tok_prob ARRAY<ARRAY<STRUCT<token STRING, prob DOUBLE>>>"
QUESTION_SET = "claim_id LONG, round INT, sample_idx INT, q_idx INT, question STRING"
CHUNK_HIT = "claim_id LONG, q_idx INT, rank INT, chunk STRING, score DOUBLE, url STRING"
ANSWER = "claim_id LONG, round INT, q_idx INT, cand_idx INT, answer STRING, statement STRING"
CHECKED = "claim_id LONG, round INT, q_idx INT, answer STRING, chunk_idx INT, retained INT"
ENTAILMENT_PAIR = "idx LONG, question_idx INT, answer_idx INT, claim STRING, label STRING, question STRING, answer STRING, statement STRING, sentence_chunks ARRAY<STRING>"
INSTRUCTION = "prompt STRING, output STRING"
SAMPLE = "input_ids ARRAY<INT>, attention_mask ARRAY<INT>, labels ARRAY<INT>"
SAFETY = "prompt STRING, response STRING, violated_category_codes ARRAY<STRING>, label STRING, explanation STRING"
CONVERSATION = "conv_id LONG, turn LONG, role STRING, text STRING"
ROUND_CONTROL = "claim_id LONG, sample_idx INT"
