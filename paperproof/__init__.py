"""Trustworthy receipt data on Spark: adapt, validate, decide, evaluate and profile, as DataFrame operators."""

from paperproof.operators.annotation import adapt_annotations
from paperproof.operators.canonical import read_receipts, schema_valid_rate
from paperproof.operators.evaluate import compare_field, evaluate_documents, evaluate_pairs, field_rates, item_matches, pair_scores, report, unmatched
from paperproof.operators.landing import land, landed, read_landed
from paperproof.operators.model_json import adapt_model_json
from paperproof.operators.ocr_lines import extract_baseline, lines_from_words
from paperproof.operators.profile import error_examples, items_per_document, merged_states, profile_report, profile_rows, profile_state, state_report, write_report
from paperproof.operators.validate import decide, decision, issue_mask, issue_rows, issues, validate
from paperproof.plans.schema import RECEIPT, RECEIPT_COLUMNS, as_json, faults
from paperproof.sources.annotations import manifest_paths, read_annotations, source_block
from paperproof.sources.answers import ask, stored_answers
from paperproof.sources.images import read_image_lines, read_pages, read_words
from paperproof.sources.model_client import HttpResponse, call_model, extract_with_model, post_json, prompts, unwrapped
from paperproof.streaming.receipts import annotation_stream, decided, reason_counts, running_profile

__all__ = [
    "RECEIPT", "RECEIPT_COLUMNS", "HttpResponse", "adapt_annotations", "adapt_model_json", "annotation_stream", "as_json", "ask", "call_model", "compare_field", "decide", "decided", "decision",
    "error_examples", "evaluate_documents", "evaluate_pairs", "extract_baseline", "extract_with_model", "faults", "field_rates", "issue_mask", "issue_rows", "issues", "item_matches",
    "items_per_document", "land", "landed", "lines_from_words", "manifest_paths", "merged_states", "pair_scores", "post_json", "profile_report", "profile_rows", "profile_state", "prompts",
    "read_annotations", "read_image_lines", "read_landed", "read_pages", "read_receipts", "read_words", "reason_counts", "report", "running_profile", "schema_valid_rate", "source_block",
    "state_report", "stored_answers", "unmatched", "unwrapped", "validate", "write_report",
]
