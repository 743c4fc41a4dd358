"""Fixed values.

The word lists, tables, thresholds and labels below are part of the results
the library must give, so they are stated here as they are, in one place.
"""

# Recommendation modes (score threshold, exploration share).
MODES = {
    "conservador": {"threshold": 0.7, "exploracao": 0.1},
    "equilibrado": {"threshold": 0.5, "exploracao": 0.2},
    "aventureiro": {"threshold": 0.3, "exploracao": 0.3},
}
DEFAULT_MODE = "equilibrado"
KNOWN_USER_TEXT = "Baseado no seu perfil de jogo"
COLD_START_TEXT = "Jogo popular recomendado para novos usuários"

# Genres of the play-time report.
PLAYTIME_GENRES = [
    "Massively Multiplayer",
    "RPG",
    "Strategy",
    "Simulation",
    "Action",
    "Adventure",
]

# Genre keyword patterns, searched in lower-cased descriptions.
GENRE_KEYWORDS = {
    "Action": "action|shooter|combat|war|battle|explosion",
    "Adventure": "adventure|explore|journey|quest|narrative",
    "RPG": "rpg|role-playing|character|fantasy world",
    "Simulation": "simulation|simulator|realistic|management",
    "Strategy": "strategy|tactical|rts|turn-based",
    "Horror": "horror|scary|spooky|survival horror",
    "Indie": "indie|independent|small team",
}

# Tags implied by the primary genre.
GENRE_TO_TAGS = {
    "Action": "Action,Shooter,Fast-Paced",
    "Adventure": "Adventure,Exploration,Story Rich",
    "RPG": "RPG,Open World,Character Customization",
    "Strategy": "Strategy,Tactical,RTS",
    "Indie": "Indie,Singleplayer,Atmospheric",
}

# Categories implied by a substring of genres and tags.
TAG_TO_CATEGORY = {
    "multiplayer": "Multi-player",
    "co-op": "Co-op",
    "singleplayer": "Single-player",
    "pvp": "PvP",
    "online": "Online",
}

# Last-resort fills of the imputation cascade.
FALLBACK_DEFAULTS = {
    "Genres": "Indie",
    "Tags": "singleplayer",
    "Categories": "Single-player",
}

# Achievement tiers of one game (upper bound inclusive).
ACHIEVEMENT_TIERS = [(1, "baixo"), (3, "médio"), (5, "alto")]
ACHIEVEMENT_TOP_TIER = "extremo"

# Right-closed bins and labels of the exploratory reports.
ACHIEVEMENT_BINS = [0, 10, 50, 150, 500]
ACHIEVEMENT_LABELS = [
    "Baixo (1-10)",
    "Médio (11-50)",
    "Alto (51-150)",
    "Extremo (151-500)",
]
PRICE_BINS = [-1, 0, 5, 20, 60, 500]
PRICE_LABELS = [
    "Gratuito",
    "Baixo (<$5)",
    "Médio ($5-20)",
    "Alto ($20-60)",
    "AAA ($60+)",
]

# Base session minutes by genre, and the default.
GENRE_BASE_SESSION_TIME = {
    "MMO": 372.0,
    "RPG": 304.0,
    "Strategy": 294.0,
    "Action": 210.0,
    "Simulation": 250.0,
    "Adventure": 180.0,
    "Casual": 90.0,
}
DEFAULT_SESSION_TIME = 120.0

# Click chance above / within / below the score band.
CLICK_HIGH, CLICK_MID, CLICK_LOW = 0.30, 0.15, 0.05

# Classifier target, default age of an undated game.
GOOD_GAME_THRESHOLD = 4.0
DEFAULT_AGE_DAYS = 3650

# Candidate thresholds per user, and the fallback among them.
CANDIDATE_THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
FALLBACK_THRESHOLD = 0.6

# Namespace of the deterministic ids (RFC 4122, name based, DNS).
UUID_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"

# Columns of the raw catalogue.
TEXT_COLUMNS = [
    "Name",
    "Genres",
    "Tags",
    "Categories",
    "Publishers",
    "Developers",
    "About the game",
    "Notes",
]
NUMERIC_COLUMNS = [
    "Price",
    "User score",
    "Positive",
    "Negative",
    "Average playtime forever",
    "Median playtime forever",
    "Peak CCU",
    "Metacritic score",
    "Achievements",
]

# Date layouts tried in order.
DATE_FORMATS = [
    "yyyy-MM-dd",
    "MMM d, yyyy",
    "d MMM, yyyy",
    "MMM yyyy",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "MMMM d, yyyy",
    "d MMMM, yyyy",
    "MMMM yyyy",
    "MMM d yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "yyyyMMdd",
    "yyyy-MM",
    "yyyy",
]
