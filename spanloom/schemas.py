"""Entities of the annotation engine as DDL schemas (readers take them as they are), and its label schemes."""

from __future__ import annotations


# Aspects, thread types and label schemes of the data format.
ASPECTS = ("SUBSTITUTION", "QUANTITY", "TECHNIQUE", "ADDITION")
THREAD_TYPES = ("statement", "question", "mixed")
BIO = {
    "O": 0,
    "B-SUBSTITUTION": 1,
    "I-SUBSTITUTION": 2,
    "B-QUANTITY": 3,
    "I-QUANTITY": 4,
    "B-TECHNIQUE": 5,
    "I-TECHNIQUE": 6,
    "B-ADDITION": 7,
    "I-ADDITION": 8,
}
IO = {"O": 0, "I-SUBSTITUTION": 1, "I-QUANTITY": 2, "I-TECHNIQUE": 3, "I-ADDITION": 4}
IGNORE = -100
AGREEMENTS = ("full", "partial", "none", "skipped", "error")
VOTE_METHODS = ("unanimous", "majority", "no_majority", "gemini_unanimous", "insufficient")

# The fields' names and kinds in the data format.
COMMENT = "struct<comment_id: string, text: string, like_count: bigint>"
REPLY = "struct<comment_id: string, text: string, like_count: bigint, is_creator: boolean>"
MODIFICATION = "struct<span: string, aspect: string, source_comment: string, confidence: double>"
ANNOTATION = f"struct<has_modification: boolean, thread_type: string, modifications: array<{MODIFICATION}>>"
SPAN_VALIDATION = (
    "struct<checked: int, kept: int, dropped: int, "
    "dropped_examples: array<struct<span: string, aspect: string, source_comment: string>>, flipped_to_no_mod: boolean>"
)

RAW_THREAD = (
    f"thread_id string, video_id string, video_title string, channel_id string, channel_title string, top_comment {COMMENT}, "
    f"replies array<{REPLY}>, has_creator_reply boolean, total_likes bigint, score int, collected_at timestamp"
)
API_COMMENT = "struct<id: string, snippet: struct<textDisplay: string, likeCount: bigint, authorChannelId: struct<value: string>>>"
API_ITEM = (
    f"snippet struct<topLevelComment: {API_COMMENT}>, replies struct<comments: array<{API_COMMENT}>>"
)
LABELED_THREAD = (
    "thread_id string, video_id string, channel_id string, video_title string, channel_title string, top_comment_text string, "
    "replies_texts array<string>, has_creator_reply boolean, total_likes bigint, "
    f"teacher_output {ANNOTATION}, teacher_model string, labeled_at timestamp, second_teacher_output {ANNOTATION}, "
    f"second_teacher_model string, third_teacher_output {ANNOTATION}, third_teacher_model string, pass3_skipped boolean, "
    "agreement_1v2 string, agreement_1v3 string, agreement_2v3 string, "
    f"final_label {ANNOTATION}, vote_method string, needs_review boolean, span_validation {SPAN_VALIDATION}"
)
CHANNEL = (
    "id string, name string, description string, subscribers bigint, videos bigint, active boolean, category string, notes string"
)
EXAMPLE = (
    "text string, modifications array<struct<span: string, aspect: string, confidence: double>>, thread_id string, source_comment string, "
    "has_modification boolean, vote_method string, reply_text string, prefix_len int, is_thread_aware boolean"
)
ALIGNED = ("input_ids array<int>, attention_mask array<int>, labels array<int>, text string, thread_id string")
GOLD = (
    "thread_id string, comment_text string, comment_position string, has_modification boolean, "
    "gold_modifications array<struct<span: string, aspect: string>>, "
    "annotator_a struct<has_modification: boolean, gold_modifications: array<struct<span: string, aspect: string>>>, "
    "annotator_b struct<has_modification: boolean, gold_modifications: array<struct<span: string, aspect: string>>>, "
    "overlap boolean, resolution string, is_reply boolean, thread_aware_text string, reply_text string, prefix_len int"
)
EVALUATION = (
    "exact_f1 double, exact_precision double, exact_recall double, relaxed_f1 double, relaxed_precision double, relaxed_recall double, "
    "token_macro_f1 double, token_accuracy double"
)
PREDICTION = (
    "text string, index int, preds array<struct<entity_group: string, score: double, word: string, start: int, end: int>>"
)
