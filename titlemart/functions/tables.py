"""Small lookup tables that results depend on."""

from __future__ import annotations

#: Raw genre label -> (English subgenre, parent).
GENRES: dict[str, tuple[str, str]] = {
    "bl": ("Boys' Love", "Romance"),
    "gl": ("Girls' Love", "Romance"),
    "로판": ("Romance Fantasy", "Romance"),
    "로맨스": ("Romance", "Romance"),
    "판타지": ("Fantasy", "Fantasy"),
    "현판": ("Modern Fantasy", "Fantasy"),
    "무협": ("Wuxia", "Action"),
    "패러디": ("Parody", "Comedy"),
    "라이트노벨": ("Light Novel", "Fantasy"),
    "드라마": ("Drama", "Drama"),
    "미스터리": ("Mystery", "Thriller"),
    "스포츠": ("Sports", "Sports"),
    "액션": ("Action", "Action"),
    "일상": ("Slice of Life", "Slice of Life"),
    "romance": ("Romance", "Romance"),
    "heartwarming": ("Heartwarming", "Romance"),
    "fantasy": ("Fantasy", "Fantasy"),
    "urban fantasy": ("Urban Fantasy", "Fantasy"),
    "urban": ("Urban Fantasy", "Fantasy"),
    "eastern": ("Eastern Fantasy", "Fantasy"),
    "portal fantasy / isekai": ("Isekai", "Fantasy"),
    "isekai": ("Isekai", "Fantasy"),
    "reincarnation": ("Reincarnation", "Fantasy"),
    "cultivation": ("Cultivation", "Fantasy"),
    "kingdom building": ("Kingdom Building", "Fantasy"),
    "ruling class": ("Kingdom Building", "Fantasy"),
    "litrpg": ("LitRPG", "Fantasy"),
    "gamelit": ("GameLit", "Fantasy"),
    "progression": ("Progression", "Fantasy"),
    "action": ("Action", "Action"),
    "wuxia": ("Wuxia", "Action"),
    "war and military": ("War & Military", "Action"),
    "superhero": ("Superhero", "Action"),
    "super heroes": ("Superhero", "Action"),
    "strategy": ("Strategy", "Action"),
    "sci-fi": ("Science Fiction", "Science Fiction"),
    "sf/fantasy": ("Science Fantasy", "Science Fiction"),
    "space opera": ("Space Opera", "Science Fiction"),
    "time loop": ("Time Loop", "Science Fiction"),
    "time travel": ("Time Travel", "Science Fiction"),
    "virtual reality": ("Virtual Reality", "Science Fiction"),
    "games": ("Gaming", "Science Fiction"),
    "drama": ("Drama", "Drama"),
    "comedy": ("Comedy", "Comedy"),
    "parody": ("Parody", "Comedy"),
    "thriller": ("Thriller", "Thriller"),
    "mystery": ("Mystery", "Thriller"),
    "crime/mystery": ("Crime & Mystery", "Thriller"),
    "psychological": ("Psychological", "Thriller"),
    "horror": ("Horror", "Horror"),
    "slice of life": ("Slice of Life", "Slice of Life"),
    "informative": ("Informative", "Slice of Life"),
    "sports": ("Sports", "Sports"),
    "historical": ("Historical", "Historical"),
    "history": ("Historical", "Historical"),
    "supernatural": ("Supernatural", "Supernatural"),
    "graphic novel": ("Graphic Novel", "Other"),
    "general": ("General", "Other"),
    "male lead": ("Male Lead", "Other"),
    "female lead": ("Female Lead", "Other"),
    "multiple lead characters": ("Ensemble Cast", "Other"),
    "anti-hero lead": ("Anti-Hero", "Other"),
}

PLATFORM_NAMES = {
    "webtoon_global": "Webtoon", "tapas_io": "Tapas", "globalcomix": "GlobalComix", "wattpad": "Wattpad",
    "mangaplus": "Manga Plus", "webcomics_app": "WebComics", "ridibooks": "Ridibooks", "webnovel": "Webnovel",
    "royalroad": "RoyalRoad", "lezhin": "Lezhin", "inkitt": "Inkitt", "joara": "Joara", "munpia": "Munpia",
}

#: Revenue model by platform: USD a thousand reads, monthly share of views, paying share of subscribers, USD a payer.
EARNINGS = {
    "webtoon_global": (0.60, 0.030, 0.020, 1.80),
    "tapas_io": (0.45, 0.040, 0.030, 2.20),
    "mangaplus": (0.35, 0.120, 0.000, 0.00),
    "wattpad": (0.15, 0.050, 0.000, 0.00),
    "webcomics_app": (0.00, 0.000, 0.050, 3.00),
    "globalcomix": (0.00, 0.000, 0.040, 4.00),
}
EARNINGS_DEFAULT = (0.30, 0.030, 0.020, 1.50)
LOW_FACTOR, HIGH_FACTOR = 0.4, 2.5

#: Weights of the composite score.
WEIGHTS = {"reach": 0.30, "momentum": 0.25, "engagement": 0.20, "monetization": 0.15, "quality": 0.10}

#: Data-quality checks: severity, and the count beyond which one fails.
THRESHOLDS = {
    "title_eq_author": ("CRITICAL", 0),
    "author_has_metric": ("CRITICAL", 0),
    "genre_is_episode_token": ("HIGH", 0),
    "within_title_author_conflict": ("HIGH", 10),
    "within_title_genre_conflict": ("MEDIUM", 25),
    "author_mislatched": ("HIGH", 0),
    "title_leading_badge": ("MEDIUM", 20),
}
