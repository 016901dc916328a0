"""Texts the recommenders answer with."""

# Genres and reasons used for generated descriptions.
GENRES = (
    "action", "adventure", "RPG", "shooter", "strategy", "simulation",
    "sports", "racing", "platformer", "puzzle", "horror", "survival",
    "open-world", "roguelike", "metroidvania", "card game", "fighting",
)
REASONS = (
    "Players who enjoyed {game} also rated this highly",
    "This shares similar gameplay elements with {game}",
    "A top pick for fans of {game}",
    "Highly recommended if you like {game}",
    "Has similar appeal to {game}",
    "Popular among {game} players",
    "Complements your interest in {game}",
    "A different take on what makes {game} enjoyable",
)

# Descriptions by lower-case title.
DESCRIPTIONS = {
    "minecraft": "A sandbox game focused on building and exploration",
    "fortnite": "A battle royale game with building mechanics",
    "zelda": "An action-adventure game with puzzles and exploration",
    "mario": "A platformer game with colorful worlds",
    "pokemon": "An RPG focused on collecting and battling creatures",
    "gta": "An open-world action game in urban environments",
    "cod": "A first-person shooter with multiplayer focus",
    "fifa": "A sports simulation game focusing on soccer",
    "skyrim": "An open-world fantasy RPG with character customization",
    "sims": "A life simulation game with building and social elements",
    "among us": "A social deduction game with teamwork and deception",
    "cyberpunk": "A futuristic RPG with first-person gameplay",
    "terraria": "A 2D sandbox adventure with crafting and exploration",
    "stardew valley": "A farming simulation RPG with relationship building",
    "apex legends": "A team-based battle royale with hero abilities",
    "overwatch": "A team-based hero shooter with objective gameplay",
    "valorant": "A tactical first-person shooter with unique character abilities",
    "rocket league": "A vehicular soccer game with physics-based gameplay",
    "animal crossing": "A life simulation game with community building",
    "hades": "A roguelike action game with Greek mythology themes",
    "hollow knight": "A challenging metroidvania with atmospheric world",
    "genshin impact": "An open-world action RPG with gacha mechanics",
}

# Answers when nothing better is known, per recommender.
NO_GAMES = (
    ("Minecraft", "A creative sandbox experience with endless possibilities"),
    ("The Legend of Zelda", "An epic adventure series with puzzle-solving and exploration"),
    ("Fortnite", "Popular battle royale game with building mechanics"),
    ("Among Us", "Social deduction game that tests your ability to spot deception"),
    ("Stardew Valley", "Relaxing farming simulation with relationship building"),
)
COMING_SOON = ("More Recommendations Coming Soon", "Our recommendation engine is constantly learning from user preferences")
GENERIC = (
    ("Minecraft", "A creative sandbox experience with endless possibilities"),
    ("The Legend of Zelda", "An epic adventure series with puzzle-solving and exploration"),
    ("Fortnite", "Popular battle royale game with building mechanics"),
    ("Rocket League", "Exciting vehicular soccer with physics-based gameplay"),
    ("Stardew Valley", "Relaxing farming simulation with relationship building"),
)
VECTOR_DEFAULTS = (
    ("Minecraft", "Creative sandbox with building and exploration"),
    ("Rocket League", "Unique sports game combining soccer and vehicles"),
    ("Among Us", "Social deduction game with teamwork and deception"),
    ("Stardew Valley", "Relaxing farming sim with relationship building"),
    ("Fortnite", "Popular battle royale with building mechanics"),
)
DISPATCH_DEFAULTS = (
    ("Minecraft", "Creative sandbox with building and exploration"),
    ("Rocket League", "Unique sports game combining soccer and vehicles"),
    ("Stardew Valley", "Relaxing farming sim with relationship building"),
)

# Game options offered to a client, and titles used when no catalog is found.
GAME_OPTIONS = ("Minecraft", "Fortnite", "Zelda", "Mario", "Pokemon", "GTA", "COD", "FIFA", "Skyrim")
FALLBACK_TITLES = (
    "Minecraft", "Fortnite", "The Legend of Zelda", "Super Mario",
    "Pokemon", "Grand Theft Auto", "Call of Duty", "FIFA",
    "The Elder Scrolls: Skyrim", "The Sims", "Among Us", "Cyberpunk 2077",
    "Terraria", "Stardew Valley", "Apex Legends", "Overwatch",
    "Valorant", "Rocket League", "Animal Crossing", "Hades",
    "Hollow Knight", "Genshin Impact", "Roblox", "Fall Guys",
)

# The recommenders a request may name.
MODEL_TYPES = ("Naive", "Deep Learning", "Traditional")
DEFAULT_MODEL = "Traditional"
