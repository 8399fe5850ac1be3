"""Tuning parameters of the operators, one frozen dataclass per stage.

Every operator takes its parameter object as an argument, so one Spark session can
run several configurations side by side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The English stop words of Spark ML's StopWordsRemover, in its order.
ENGLISH_STOP_WORDS: tuple[str, ...] = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
    "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd",
    "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't",
    "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could",
    "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's",
    "where's", "who's", "why's", "would",
)

# Review filler that is removed before topics are discovered.
REVIEW_STOP_WORDS: tuple[str, ...] = (
    # generic app words
    "app", "apps", "application", "phone", "mobile", "version", "star", "stars",
    "rating", "review", "reviews",
    # sentiment
    "good", "bad", "worst", "best", "nice", "great", "awesome", "amazing",
    "excellent", "terrible", "horrible", "poor", "worse", "better", "super", "cool",
    "fine", "okay", "ok", "love", "loved", "like", "hate", "waste", "useless",
    "pathetic", "disappointed", "disappointing", "pls", "plz", "please",
    # generic verbs and adverbs
    "use", "used", "using", "get", "got", "just", "really", "very", "well", "thing",
    "things", "want", "make", "made", "dont", "doesnt", "cant", "didnt", "im", "ive",
    # common Hinglish filler
    "aap", "hai", "hi", "ha", "haan", "bhi", "nahi", "kya", "aur", "mera", "bahut",
    "kar", "karo", "pe", "se", "ko", "ka", "ki", "ke", "na", "ye", "wo", "jo", "tha",
    "ho", "hua", "raha", "rahe", "liye", "sab", "ab", "toh", "kaise", "kyu", "kyun",
    "working",
)


@dataclass(frozen=True)
class TextParams:
    k_min: int = 2
    k_max: int = 6
    max_issue_rating: int | None = 3
    min_words: int = 4
    min_reviews: int = 10
    min_df: int = 2
    max_df: float = 0.9
    ngram_max: int = 2
    top_keywords: int = 8
    n_representative: int = 3
    seed: int = 42
    # Seeded restarts per number of clusters, and how many fit side by side.
    n_init: int = 10
    parallel_fits: int = 8
    # Fits end by convergence; one that reaches this number of steps is repeated with more.
    max_iter: int = 300
    # General list; the review filler is always added.
    stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS
    extra_stop_words: tuple[str, ...] = REVIEW_STOP_WORDS
    # Joins cut terms with more rows than this into slices.
    slice_rows: int = 100_000


@dataclass(frozen=True)
class TrendParams:
    freq: str = "W"
    rolling_periods: int = 4
    min_baseline: int = 2
    growth_lookback: int = 2
    anomaly_z: float = 2.0
    min_mentions: int = 3
    w_growth: float = 0.30
    w_deviation: float = 0.25
    w_rating: float = 0.20
    w_negative: float = 0.15
    w_volume: float = 0.10
    growth_cap: float = 1.0
    z_cap: float = 3.0
    volume_cap: float = 20.0
    confidence_cap: float = 30.0
    risk_high: float = 66.0
    risk_medium: float = 40.0
    confidence_high: float = 0.66
    confidence_medium: float = 0.33


@dataclass(frozen=True)
class ImpactParams:
    min_sample: int = 30
    hard_floor: int = 5
    alpha: float = 0.05
    low_rating: int = 2
    normal_min_n: int = 20
    min_regression_rows: int = 10
    # Issues whose regressions are evaluated together in one array.
    issue_chunk: int = 256


@dataclass(frozen=True)
class ForecastParams:
    horizon: int = 2
    min_history: int = 5
    min_fit: int = 4
    alpha: float = 0.05
    impact_critical: float = 0.30
    impact_high: float = 0.15
    impact_medium: float = 0.05
    disproportion_gap: float = 0.20
    flat_slope: float = 1e-4
    freq: str = "W"


@dataclass(frozen=True)
class Params:
    text: TextParams = field(default_factory=TextParams)
    trend: TrendParams = field(default_factory=TrendParams)
    impact: ImpactParams = field(default_factory=ImpactParams)
    forecast: ForecastParams = field(default_factory=ForecastParams)
