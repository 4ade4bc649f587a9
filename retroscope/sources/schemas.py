"""Explicit schemas of the layers and of the landed files."""

RAW_POST = (
    "id string, subreddit string, title string, selftext string, created_utc double, "
    "created_dt string, num_comments int, score int, permalink string, url string"
)

LISTING = (
    "data struct<after: string, children: array<struct<kind: string, data: struct<"
    "id: string, subreddit: string, title: string, selftext: string, created_utc: double, "
    "num_comments: int, score: int, permalink: string, url: string>>>>"
)

# replies is an object or an empty string, so it is read as text and parsed on its own
THREAD_POST = (
    "data struct<children: array<struct<data: struct<"
    "author: string, upvote_ratio: double, title: string>>>>"
)
THREAD_COMMENTS = (
    "data struct<children: array<struct<kind: string, data: struct<"
    "body: string, author: string, replies: string>>>>"
)
THREAD_REPLIES = (
    "data struct<children: array<struct<kind: string, data: struct<body: string, author: string>>>>"
)

ANNOTATION = (
    "decision_type string, specific_trigger string, reversal_confident boolean, "
    "reversal_direction string, agency_level string, emotional_clarity string"
)

COMMENT_COLUMNS = ["upvote_ratio", "comment_vader_mean", "reversal_comment_score",
                   "n_op_replies", "n_top_comments"]
