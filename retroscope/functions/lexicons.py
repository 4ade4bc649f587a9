"""Fixed values.

Word lists, phrase lists, patterns and constants that decide the results. They
are data, listed in the order in which they are tried; nothing is computed here.
Matching is by raw substring on lower-cased text unless a pattern says otherwise.
"""

# --- fixed values: which posts to keep ------------------------------------------------
KEEP_PATTERNS = [
    r"\bi regret\b",
    r"\bi regret it\b",
    r"\bi regret that\b",
    r"\bi wish i had\b",
    r"\bi messed up\b",
    r"\bi fucked up\b",
    r"\bmy biggest mistake\b",
]

EXCLUDE_PATTERNS = [
    r"\bwill i regret\b",
    r"\bwhat if i regret\b",
    r"\bbefore i regret\b",
    r"\bmight regret\b",
    r"\byou('ll| will) regret\b",
    r"\bthey('ll| will) regret\b",
]

# --- fixed values: labels of the structured layer -------------------------------------
SENTENCE_CUES = ["regret", "wish i had", "messed up", "fucked up"]
SENTENCE_MIN_CHARS = 30
SENTENCE_MAX_CHARS = 500

REVERSAL_ACTIONS = [
    "quit", "left", "resigned", "declined", "turned down", "rejected",
    "fired", "laid off", "layoff", "terminated",
    "withdrew", "dropped out", "moved back", "switched",
    "changed jobs", "changed careers",
]

URGENCY_WORDS = [
    "rushed", "pressure", "deadline", "last minute", "forced", "urgent",
    "quick decision", "panicked", "impulsive", "no time", "asap",
]

NEGATED_PHRASES = [
    "don't regret",
    "do not regret",
    "no regret",
    "not regret",
    "don't really regret",
    "do not really regret",
]

MAX_DURATION_DAYS = 3650
DEFAULT_YEAR = 2024

# --- fixed values: first version of the labels (sentence-only actions) ----------------
REVERSAL_ACTIONS_V1 = [
    "quit", "left", "resigned", "divorced", "moved back", "withdrew",
    "dropped out", "changed careers", "changed jobs", "switched",
]

URGENCY_WORDS_V1 = [
    "rushed", "pressure", "deadline", "last minute", "forced", "urgent",
    "quick decision", "panicked", "impulsive",
]

# --- fixed values: durations ----------------------------------------------------------
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}

# (pattern, words of which any match holds one); tried in order, the first that matches
# decides. Each holds one number and one unit.
DURATION_PATTERNS = [
    (r"(\d+)\s+(day|week|month|year)s?\s+later", ["later"]),
    (r"after\s+(\d+)\s+(day|week|month|year)s?", ["after"]),
    (r"(it'?s been|has been)\s+(\d+)\s+(day|week|month|year)s?", ["s been"]),
]
YEAR_PATTERN = (r"(in|back in)\s+(20\d{2})", ["20"])

# ((pattern, words), units meant where no number is written, divisor); an out-of-range value
# falls through to the next pattern
REFINED_PATTERNS = [
    ((r"\ba\s+(day|week|month|year)\s+(later|ago)", ["later", "ago"]), 1, 1),
    ((r"a couple(?:\s+of)?\s+(day|week|month|year)s?", ["a couple"]), 2, 1),
    ((r"a few\s+(day|week|month|year)s?", ["a few"]), 3, 1),
    ((r"several\s+(day|week|month|year)s?", ["several"]), 5, 1),
    ((r"half a\s+(year|month)", ["half a"]), 1, 2),
    ((r"(\d+)\s+(day|week|month|year)s?\s+ago", ["ago"]), None, 1),
    ((r"over\s+(\d+)\s+(day|week|month|year)s?", ["over"]), None, 1),
    ((r"almost\s+(\d+)\s+(day|week|month|year)s?", ["almost"]), None, 1),
    ((r"\blast\s+(year|month|week)", ["last"]), 1, 1),
]
MONTH_YEAR_PATTERN = (
    r"(?:in|since|around|back in)\s+"
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|"
    r"jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
    r"\s+(20\d{2})",
    ["20"],
)
REFINED_MIN_CHARS = 10

# --- fixed values: triggering events, first match wins --------------------------------
EVENT_TAXONOMY = {
    "immigration": [
        ("visa_denial_or_error", [
            "denied", "rejection", "denied my", "application denied", "visa denied",
            "gc denied", "rejected application", "rfe", "request for evidence",
            "filed wrong", "wrong form", "filing error", "mistake on application",
            "denial notice", "denial letter", "case denied",
        ]),
        ("status_or_removal", [
            "out of status", "unlawful presence", "overstay", "overstayed",
            "deported", "deportation", "removal order", "status expired",
            "expired visa", "unauthorized", "undocumented",
        ]),
        ("sponsor_or_job_loss", [
            "employer withdrew", "sponsor withdrew", "h1b cancelled", "h-1b cancelled",
            "company laid", "lost my job", "job loss", "employer pulled",
            "revoked by employer", "company went under",
        ]),
        ("voluntary_departure", [
            "moved back", "returned home", "back home", "left the country",
            "going back home", "returned to my country", "back to my home country",
            "relocated back", "went back",
        ]),
        ("application_trapped", [
            "still waiting", "years of waiting", "waiting for", "pending for",
            "in process", "case is pending", "stuck in", "backlog",
            "processing delay", "priority date",
        ]),
    ],
    "relationships": [
        ("abuse_or_toxicity", [
            "abuse", "abusive", "toxic", "controlling", "manipulation",
            "manipulative", "gaslighting", "harass", "threatening",
            "emotional abuse", "physically abusive", "narcissist",
        ]),
        ("infidelity", [
            "cheated", "cheating", "affair", "unfaithful", "betrayed",
            "cheat on", "was cheating",
        ]),
        ("external_pressure", [
            "family pressure", "parents forced", "forced to", "pressure from family",
            "arranged marriage", "long distance", "family disapproved",
        ]),
        ("voluntary_end", [
            "broke up", "broke it off", "ended the relationship", "ended things",
            "ended it", "left him", "left her", "left them", "divorced",
            "split up", "walked away", "cut ties",
        ]),
        ("conflict", [
            "constant fighting", "argument", "always fighting",
            "toxic fight", "disagreement", "incompatible",
        ]),
    ],
    "career": [
        ("involuntary_exit", [
            "fired", "laid off", "layoff", "let go", "terminated",
            "pushed out", "restructur", "downsiz", "position eliminated",
            "was let go", "got fired", "got laid off",
        ]),
        ("rejected_offer", [
            "turned down the offer", "declined the offer", "rejected the offer",
            "turned it down", "said no to the offer", "rejected a job",
            "declined a job", "turned down a job", "rejected the position",
        ]),
        ("counteroffer_or_switch", [
            "accepted a counteroffer", "took a counteroffer", "switched to",
            "moved to another company", "took a different job", "jumped ship",
        ]),
        ("voluntary_quit", [
            "quit", "resigned", "gave notice", "two weeks notice",
            "left the company", "left my job", "walked out",
            "put in my notice",
        ]),
        ("promotion_or_raise_missed", [
            "missed the promotion", "passed over", "didn't get promoted",
            "no raise", "rejected for promotion", "promotion went to",
        ]),
    ],
}
UNKNOWN_EVENT = "unknown"
DOMAINS = ["career", "immigration", "relationships"]

# --- fixed values: psycholinguistic phrase lists --------------------------------------
AGENCY_ACTIVE = [
    "i chose", "i decided", "i wanted", "my choice", "i selected",
    "i picked", "i opted", "i made the decision", "i took",
    "it was my decision", "i initiated",
]
AGENCY_PASSIVE = [
    "was forced", "had to", "no choice", "had no option", "i was made to",
    "couldn't say no", "pressured into", "forced me", "didn't have a choice",
    "no other option", "was pushed", "was told to", "had no say",
]
HEDGING = [
    "maybe", "perhaps", "i think", "possibly", "not sure", "i guess",
    "might be", "could be", "kind of", "sort of", "somewhat",
    "i'm not certain", "i don't know if", "probably", "seemingly",
]
SOCIAL_EMBED = [
    "my wife", "my husband", "my partner", "my parents", "my kids",
    "my family", "my mom", "my dad", "my mother", "my father",
    "my brother", "my sister", "my son", "my daughter", "my boyfriend",
    "my girlfriend", "my spouse", "my children", "my friends",
    "my boss", "my coworker", "my colleague",
]
CAUSAL = [
    "because", "therefore", "so that", "as a result", "which led to",
    "caused", "due to", "consequently", "led me to", "the reason",
    "that's why", "which is why", "owing to", "on account of",
]
FUTURE = [
    "will", "going to", "plan to", "intend to", "hope to",
    "looking forward", "want to", "aiming to", "planning on",
    "considering", "thinking about", "might try",
]

# --- fixed values: comment threads ----------------------------------------------------
UPDATE_PHRASES = [
    "ended it", "broke up", "quit", "resigned", "left",
    "moved back", "filed", "withdrew", "took the job", "rejected",
    "accepted", "got divorced", "separated", "moved out", "moved on",
    "started the process", "submitted", "applied", "went back",
    "switched jobs", "gave notice", "walked away",
]
DEAD_COMMENTS = ["[deleted]", "[removed]"]

# --- fixed values: word contrasts -----------------------------------------------------
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself he him his she her "
    "hers it its they them their theirs what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if "
    "or because as until while of at by for with about against between through during "
    "before after above below to from up down in out on off over under again further then "
    "once here there when where why how all both each few more most other some such no nor "
    "not only own same so than too very s t can will just don should now d ll m o re ve y "
    "ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn "
    "weren won wouldn would could"
).split()
MODAL_VERBS = ["should", "could", "would", "wish", "might", "must"]

# --- fixed values: reading samples by eye ---------------------------------------------
STRONG_PATTERNS = [
    r"\bi regret\b",
    r"\bi wish i had\b",
    r"\bi wish i'd\b",
    r"\bif only i had\b",
    r"\bbiggest mistake\b",
    r"\bshouldn't have\b",
    r"\bshould not have\b",
    r"\bi messed up\b",
    r"\bi fucked up\b",
]
PAST_ACTION_VERBS = [
    "took", "accepted", "chose", "married", "moved", "quit", "left", "applied", "filed",
    "decided", "stayed", "joined", "signed", "changed", "started", "ended", "broke", "broke up",
    "got", "got fired", "turned down",
]
SNIPPET_WINDOW = 90

# --- fixed values: scoring of new texts -----------------------------------------------
DOMAIN_KEYWORDS = {
    "career": ["job", "career", "salary", "company", "quit", "fired", "hired",
               "promotion", "boss", "coworker", "work", "resign"],
    "immigration": ["visa", "h1b", "immigration", "green card", "uscis", "move to",
                    "moved to", "country", "citizen", "immigrant", "asylum"],
    "relationships": ["boyfriend", "girlfriend", "partner", "marriage", "divorced",
                      "breakup", "broke up", "relationship", "wife", "husband", "dating"],
}
SCORING_REVERSAL_WORDS = [
    "quit", "left", "resigned", "divorced", "moved back",
    "withdrew", "dropped out", "changed careers", "switched",
]
TEMPORAL_PATTERNS = [
    r"\d+\s+(day|week|month|year)s?\s+(ago|later)",
    r"after\s+\d+\s+(day|week|month|year)s?",
    r"(in|back in|since)\s+20\d{2}",
    r"(last|past)\s+(week|month|year|few\s+(months|years))",
]
# domain, reversal rate, median days
DOMAIN_BASELINES = [
    ("career", 0.385, 210),
    ("immigration", 0.276, 365),
    ("relationships", 0.395, 60),
]
EMOTIONS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
EMOTION_NOTES = {
    "sadness": "Sadness is the most common emotion in regret posts and is associated with "
               "higher reversal rates (39.9%).",
    "anger": "Anger-driven regret often reflects interpersonal conflict and tends toward action.",
    "neutral": "Neutral-toned posts tend to have lower reversal rates (26.3%), suggesting "
               "ongoing deliberation.",
}

# --- fixed values: eras (last year included, label) -----------------------------------
ERAS = [(2019, "pre_covid"), (2021, "covid"), (9999, "post_covid")]

# --- fixed values: layers -------------------------------------------------------------
MASTER_COLUMNS = [
    "id", "domain", "source_subreddit", "subreddit",
    "title", "selftext", "full_text",
    "created_utc", "created_dt", "created_dt_parsed", "post_year",
    "num_comments", "score", "permalink", "url",
    "keep", "exclude",
    "regret_sentence", "reversal", "urgency_score",
    "time_to_regret_days",
    "topic", "negated_regret",
]
PUBLISH_COLUMNS = [
    "id", "domain", "source_subreddit", "title", "regret_sentence",
    "vader_compound", "vader_neg", "urgency_score", "reversal",
    "time_to_regret_days", "topic", "emotion", "emotion_score",
    "event_type", "agency_score", "hedging_score",
    "social_embed_score", "causal_reasoning_score", "future_orient_score",
]
IMMIGRATION_FILE_WORDS = ["immigration", "iwantout", "uscis", "visa", "greencard", "h1b", "f1visa"]
RELATIONSHIP_FILE_WORDS = ["relationships", "relationship_advice"]

# --- a small demonstration lexicon of our own -----------------------------------------
# Real use passes a full lexicon as a table (see operators.sentiment.lexicon_join).
DEMO_VALENCE = {
    "regret": -1.8, "mistake": -1.5, "messed": -1.6, "sad": -2.1, "toxic": -2.3,
    "abusive": -3.0, "cheated": -2.4, "fired": -1.9, "denied": -1.4, "panicked": -2.0,
    "pressure": -1.1, "forced": -1.6, "stuck": -1.2, "fucked": -2.2, "wish": 0.6,
    "friends": 1.9, "special": 1.7, "quiet": 0.4, "worth": 1.3, "good": 1.9,
    "happy": 2.7, "love": 3.1, "hate": -2.8,
}
DEMO_EMOTION = {
    "sad": "sadness", "regret": "sadness", "wish": "sadness", "toxic": "anger",
    "abusive": "anger", "forced": "anger", "fucked": "disgust", "cheated": "disgust",
    "panicked": "fear", "pressure": "fear", "deadline": "fear", "friends": "joy",
    "worth": "joy", "update": "surprise", "denied": "surprise",
}
# published constants of the rule-based sentiment model
BOOSTERS = {"very": 0.293, "really": 0.293, "so": 0.293, "extremely": 0.293, "too": 0.293,
            "totally": 0.293, "slightly": -0.293, "barely": -0.293, "somewhat": -0.293}
NEGATORS = ["not", "no", "never", "don't", "didn't", "can't", "won't", "without", "nothing"]
NEGATION_FACTOR = -0.74
DISTANCE_DAMPING = [1.0, 0.95, 0.9]
NORMALISER = 15.0
