"""Word lists, rules, thresholds and names that results depend on."""

# Sentiment lexicon. A phrase counts once when it occurs anywhere in the text.
POSITIVE_WORDS = (
    "great", "love", "smooth", "fast", "amazing", "excellent",
    "awesome", "good", "helpful", "easy", "perfect", "reliable",
)
NEGATIVE_WORDS = (
    "terrible", "doesn't work", "doesnt work", "failed", "worst", "scam", "uninstall", "bad",
    "awful", "error", "broken", "crash", "stuck", "unable", "declined", "not working",
)
NEGATORS = ("not", "never")
NEGATED_WORK_WORDS = ("work", "works", "working")

# Issue rules, in output order. label -> (phrases, pattern)
ISSUE_RULES = {
    "Transaction Failure": (
        ("payment failed", "transfer failed", "transaction failed", "declined",
         "not going through", "chargeback", "pending forever", "refund not received"),
        r"\b(payment|transfer|transaction|withdrawal|deposit)\b.{0,24}\b(fail(?:ed|ure)?|declin(?:e|ed)|error)\b",
    ),
    "Login/Auth Issues": (
        ("can't login", "cannot login", "unable to login", "otp not received", "2fa",
         "verification failed", "password reset", "face id", "fingerprint", "authentication error"),
        r"\b(login|log in|signin|sign in|auth|authentication|otp|verification|password)\b.{0,24}\b(fail(?:ed|ure)?|error|stuck|not working)\b",
    ),
    "Performance Issues": (
        ("slow", "laggy", "freezes", "takes forever", "loading forever",
         "very sluggish", "unresponsive", "high battery usage", "overheating"),
        r"\b(slow|lag|sluggish|freeze|stutter|unresponsive)\b",
    ),
    "Glitches/Bugs": (
        ("bug", "glitch", "crash", "crashes", "keeps crashing",
         "not working", "stuck on", "blank screen", "broken"),
        r"\b(crash(?:es|ed|ing)?|bug(?:s)?|glitch(?:es)?|broken|stuck)\b",
    ),
    "UI/UX Problems": (
        ("hard to use", "confusing", "bad design", "poor layout", "cannot find",
         "too many steps", "ui issue", "ux issue", "navigation is bad"),
        r"\b(ui|ux|layout|design|navigation)\b.{0,24}\b(bad|poor|confusing|hard|difficult)\b",
    ),
    "Policy Complaints": (
        ("fees are high", "hidden charges", "policy changed", "unfair policy",
         "terms changed", "suspended account", "blocked account", "compliance hold"),
        r"\b(fee|charges|policy|terms|compliance|kyc)\b.{0,24}\b(unfair|bad|changed|problem)\b",
    ),
    "Feature Requests": (
        ("please add", "need feature", "would like", "it would be great",
         "wish you had", "add dark mode", "add export", "support apple pay"),
        r"\b(add|need|wish|request|feature)\b.{0,28}\b(feature|option|support|mode|integration)\b",
    ),
    "Customer Support": (
        ("support not responding", "customer service", "no response", "chat support",
         "help desk", "agent was rude", "ticket unresolved", "no one helped"),
        r"\b(support|customer service|agent|ticket|help desk)\b.{0,24}\b(no response|unhelpful|rude|slow|bad)\b",
    ),
}
NEAR_FAILURE_PATTERN = r"\b(can't|cant|cannot|failed|failure|error)\b"
NEAR_FAILURE_GAP = 40

# Severity terms, labels, weights and bands.
FAILURE_TERMS = ("failed", "error", "declined", "not working", "stuck", "crash", "can't", "cant", "unable")
CRITICAL_ISSUES = ("transaction failure", "login/auth issues")
HIGH_ISSUES = ("performance issues", "glitches/bugs")
SEVERITY_WEIGHTS = {"rating": 0.35, "sentiment": 0.25, "failure": 0.15, "issue": 0.15, "thumbs": 0.10}
SEVERITY_BANDS = ((0.80, "critical"), (0.60, "high"), (0.30, "med"))

# Category names and markers.
TAXONOMY_MAP = {
    "account_balance": "Account & Balance",
    "card_management": "Card Management",
    "money_transfers": "Payments & Transfers",
    "login": "Login & Authentication",
    "authentication": "Login & Authentication",
    "security": "Login & Authentication",
    "performance": "App Performance",
    "crash": "App Performance",
    "notifications": "Notifications",
    "__fallback__": "Other",
}
EMPTY_REVIEW = "[EMPTY_REVIEW]"

# Accepted header spellings per target column.
HEADER_ALIASES = {
    "review_id": ("reviewId", "review_id", "id", "reviewid"),
    "user_name": ("userName", "user_name", "username", "user"),
    "content": ("content", "review", "review_text", "text", "comment"),
    "score": ("score", "rating", "stars", "star_rating"),
    "thumbs_up": ("thumbsUpCount", "thumbs_up", "thumbsupcount", "helpful_count"),
    "review_created_version": ("reviewCreatedVersion", "review_created_version", "reviewversion"),
    "at_ts": ("at", "at_ts", "created_at", "timestamp", "date"),
    "app_version": ("appVersion", "app_version", "version", "appversion"),
    "category_raw": ("category", "category_raw", "categoryname", "topic"),
}

# Churn intent wording.
CHURN_INTENT = ("uninstall", "cancel", "close account", "switching")

# Text of the deterministic weekly brief.
BRIEF_RISKS = {
    "negative": ("Negative sentiment remains elevated", "high"),
    "critical": ("Critical incidents may impact retention", "med"),
    "filler": ("Issue concentration may reduce trust", "low"),
}
BRIEF_FILLER_SIGNAL = "Top issues concentrated in a few themes"
BRIEF_RECOMMENDATIONS = (
    ("Prioritize fixes for top severity drivers in next sprint", "Eng",
     "Reduce negative sentiment and critical volume"),
    ("Publish known-issues guidance for affected users", "Support",
     "Lower ticket friction and improve user confidence"),
    ("Align roadmap updates with highest-frequency complaints", "PM",
     "Improve rating trajectory and perceived responsiveness"),
)
