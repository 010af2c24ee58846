"""Word lists, thresholds and lookup tables of the rules.

These are data, kept together and in their natural order, because results
depend on every entry (and, where a rule says so, on the order).
"""

# --- fixed values: store chains -------------------------------------------------
TARGET_STORES = [
    "Real Canadian Superstore", "No Frills", "Save-On-Foods", "Calgary Co-op",
    "Sobeys", "Safeway", "Walmart",
]
STORE_SHORT_NAMES = {
    "Real Canadian Superstore": "Superstore",
    "No Frills": "No Frills",
    "Save-On-Foods": "Save-On",
    "Calgary Co-op": "Co-op",
    "Sobeys": "Sobeys",
    "Safeway": "Safeway",
    "Walmart": "Walmart",
}
FILE_NAME_STORES = [
    ("sobeys", "Sobeys"), ("safeway", "Safeway"),
    ("superstore", "Real Canadian Superstore"), ("real canadian", "Real Canadian Superstore"),
    ("save-on", "Save-On-Foods"), ("save on", "Save-On-Foods"), ("saveon", "Save-On-Foods"),
    ("co-op", "Calgary Co-op"), ("coop", "Calgary Co-op"), ("co op", "Calgary Co-op"),
    ("no frills", "No Frills"), ("nofrills", "No Frills"),
]
FEED_EXCLUSIONS = ["liquor", "wine", "beer", "spirits", "alcohol", "optical", "pharmacy"]
EXCLUDED_MERCHANTS = ["liquor", "pharmacy", "wine", "beer", "spirits", "lcbo", "liquor store"]
ARCHIVE_EXCLUSIONS = ["liquor", "wine", "beer", "spirits"]
EXCLUDED_ITEM_WORDS = [
    "liquor", "pharmacy", "wine", "beer", "spirits",
    "cannabis", "tobacco", "prescription", "optometry", "gift card",
]

# --- fixed values: key items and presets ----------------------------------------
KEY_ITEMS = [
    "milk", "bread", "eggs", "butter", "cheese", "chicken breast",
    "ground beef", "bacon", "rice", "pasta", "cereal", "yogurt",
    "orange juice", "coffee", "sugar", "flour", "cooking oil",
    "bananas", "apples", "potatoes", "onions", "tomatoes", "lettuce",
]
PROTEIN_CATEGORIES = ["Beef", "Pork", "Poultry", "Lamb", "Seafood"]
REPORT_PROTEINS = ["Pork", "Poultry", "Beef", "Seafood", "Lamb"]
REPORT_OTHERS = ["Produce", "Dairy & Eggs", "Bakery", "Pantry", "Frozen", "Snacks", "Beverages"]
PRIORITY_CATEGORIES = {
    "Proteins": ["Meat & Seafood"],
    "Dairy & Breakfast": ["Dairy & Eggs", "Breakfast"],
    "Produce": ["Produce"],
    "Pantry Staples": ["Pantry", "Bakery"],
    "Frozen Essentials": ["Frozen Foods"],
}
PROTEIN_WORDS = [
    "meat", "chicken", "beef", "pork", "fish", "salmon", "turkey", "steak",
    "protein", "eggs", "bacon", "ground", "roast",
]
PREMIUM_WORDS = ["organic", "grass", "prime", "angus", "wild", "aaa", "sterling"]

# --- fixed values: beverage exclusion -------------------------------------------
DRINK_KEYWORDS = [
    "vodka", "rum", "whisky", "whiskey", "gin", "tequila", "cognac", "brandy",
    "bourbon", "scotch", "mezcal", "absinthe", "vermouth", "schnapps", "sake",
    "merlot", "cabernet", "chardonnay", "sauvignon blanc", "pinot noir",
    "pinot grigio", "riesling", "malbec", "shiraz", "syrah", "zinfandel",
    "prosecco", "champagne", "cava", "moscato",
    "smirnoff", "absolut", "grey goose", "bacardi", "captain morgan",
    "jack daniels", "crown royal", "johnnie walker", "hennessy", "baileys",
    "jagermeister", "kahlua", "malibu", "fireball",
    "white claw", "truly hard", "twisted tea", "palm bay",
    "craft beer", "lager", "pilsner", "stout", "porter", "pale ale", "ipa",
]
DRINK_PHRASES = [
    "wine bottle", "red wine", "white wine", "rose wine", "rosé wine",
    "sparkling wine", "table wine", "beer case", "beer pack", "tall can",
    "rtd cocktail", "hard lemonade", "hard soda", "cooler pack", "spirit mix",
]
DRINK_WHITELIST = [
    "non-alcoholic", "non alcoholic", "de-alcoholized", "dealcoholized",
    "alcohol-free", "alcohol free", "0%", "zero alcohol", "na beer",
    "wine vinegar", "wine sauce", "cooking wine",
]

# --- fixed values: counter goods priced per 100 g --------------------------------
COUNTER_STORES = ["Sobeys", "Safeway", "Calgary Co-op", "Save-On-Foods"]
COUNTER_MIN_PRICE = 0.30
COUNTER_PATTERNS = [
    (r"(?:fresh\s+)?atlantic\s+salmon\s+(?:fillet|roast|portion|steak)", 8.0),
    (r"^atlantic\s+salmon$", 8.0),
    (r"(?:fresh\s+)?marinated\s+(?:atlantic\s+)?salmon\s+fillet", 8.0),
    (r"marinated\s+fresh\s+atlantic\s+salmon", 8.0),
    (r"(?:fresh\s+)?(?:wild\s+)?(?:pacific\s+)?cod\s+fillet", 8.0),
    (r"^cod\s+fillets?$", 8.0),
    (r"(?:fresh\s+)?(?:wild\s+)?halibut(?:\s+fillet|\s+steak)?", 15.0),
    (r"(?:fresh\s+)?steelhead\s+trout(?:\s+fillet)?", 8.0),
    (r"(?:fresh\s+)?(?:whole\s+)?rainbow\s+trout", 8.0),
    (r"^trout\s+fillets?$", 8.0),
    (r"(?:fresh\s+)?(?:wild\s+)?(?:pacific\s+)?sole\s+fillet", 8.0),
    (r"(?:fresh\s+)?(?:wild\s+)?tilapia\s+fillet", 6.0),
    (r"(?:fresh\s+)?haddock\s+fillet", 8.0),
    (r"(?:fresh\s+)?swordfish", 12.0),
    (r"(?:fresh\s+)?mahi\s+mahi", 10.0),
    (r"(?:wild\s+)?yellowfin\s+tuna\s+steak", 10.0),
    (r"coho\s+salmon\s+fillet", 8.0),
    (r"(?:wild\s+)?sockeye\s+salmon\s+fillet", 8.0),
    (r"chinook\s+(?:red\s+spring\s+)?salmon\s+fillet", 8.0),
    (r"red\s+spring\s+salmon\s+fillet", 8.0),
    (r"^chicken\s+wings?$", 5.0),
    (r"^chicken\s+wings?\s*,", 5.0),
    (r"^(?:glazed|marinated)\s+chicken\s+wings?$", 5.0),
]
COUNTER_BRANDS = [
    "compliments", "maple leaf", "schneiders", "janes", "high liner",
    "seaquest", "sea quest", "panache", "cardinal", "pinty",
    "belmont", "great value", "no name", "pc ", "kelseys",
    "impossible", "marcangelo", "johnsonville", "sufra",
    "country classics", "western family", "hayter", "clover leaf",
    "betty crocker", "ultra natural", "true north",
]
COUNTER_TERMS = [
    "frozen", "breaded", "battered", "cooked", "smoked", "cured", "canned",
    "nugget", "strip", "tender", "bite", "burger", "sausage", "cake",
    "pot pie", "entrée", "entree", "ready to", "in-store",
    "schnitzel", "meatball", "pepperette", "kolbassa",
    "air-chilled", "air chilled", "helper", "cheese ball",
    "crusted", "flavoured", "popcorn", "imitation",
]
PACKAGE_WEIGHT = r"(?:\d{2,}|\d*\.\d+)\s*(?:g|kg|lb|lbs|oz)\b"

# --- fixed values: prepared meat -------------------------------------------------
PREPARED_WORDS = [
    "deli", "sliced", "lunch meat", "sandwich", "rotisserie", "cooked",
    "smoked", "cured", "jerky", "pepperoni", "salami", "prosciutto",
    "ham slice", "turkey slice", "chicken slice", "roast beef slice",
    "nugget", "finger", "strip", "tender", "popcorn chicken", "wing zing",
    "breaded", "battered", "frozen dinner", "frozen entree", "meal kit",
    "stuffed", "marinated", "seasoned", "ready to eat", "heat and serve",
    "corn dog", "hot dog", "wiener", "frankfurter", "bologna", "mortadella",
    "pate", "liverwurst", "head cheese",
]

# --- fixed values: keyword categories, first category wins -----------------------
POULTRY_SAUSAGE = ["chicken sausage", "turkey sausage"]
PORK_SAUSAGE = [
    "pork sausage", "bratwurst", "italian sausage", "kolbassa", "kielbasa",
    "chorizo", "johnsonville",
]
CATEGORY_WORDS = {
    "Produce": [
        "apple", "banana", "orange", "grape", "berry", "strawberry", "blueberry",
        "lettuce", "spinach", "kale", "broccoli", "carrot", "potato", "tomato",
        "onion", "pepper", "cucumber", "celery", "mushroom", "avocado", "mango",
        "lemon", "lime", "peach", "pear", "plum", "melon", "watermelon",
        "zucchini", "squash", "asparagus", "corn", "peas", "beans", "cabbage",
    ],
    "Beef": [
        "beef", "steak", "ground beef", "sirloin", "ribeye", "tenderloin", "brisket",
        "eye of round", "chuck", "flank", "prime rib", "strip loin", "t-bone",
    ],
    "Pork": [
        "pork", "bacon", "ham", "pork chop", "pork loin", "pork tenderloin",
        "pork belly", "back ribs", "side ribs", "pork shoulder",
    ],
    "Poultry": [
        "chicken", "turkey", "duck", "chicken breast", "chicken thigh",
        "chicken wing", "drumstick", "whole chicken", "cornish hen",
    ],
    "Lamb": ["lamb", "lamb chop", "lamb leg", "lamb shoulder", "rack of lamb"],
    "Seafood": [
        "salmon", "shrimp", "fish", "tuna", "cod", "tilapia", "halibut",
        "prawn", "crab", "lobster", "haddock", "sole", "trout", "scallop",
        "mussel", "clam", "pollock", "basa", "snapper",
    ],
    "Dairy & Eggs": [
        "milk", "cheese", "yogurt", "butter", "egg", "cream", "sour cream",
        "margarine", "whipping cream", "cottage cheese",
    ],
    "Bakery": [
        "bread", "bagel", "muffin", "croissant", "bun", "roll", "tortilla", "pita",
        "naan", "wrap", "english muffin", "ciabatta",
    ],
    "Pantry": [
        "pasta", "rice", "cereal", "soup", "sauce", "oil", "flour", "sugar",
        "canned", "peanut butter", "jam", "honey", "vinegar", "broth",
    ],
    "Frozen": ["frozen", "ice cream", "pizza", "frozen dinner", "popsicle", "gelato"],
    "Beverages": [
        "juice", "soda", "pop", "water", "coffee", "tea", "energy drink",
        "protein shake", "kombucha", "sparkling",
    ],
    "Snacks": [
        "chip", "chips", "cracker", "cookie", "candy", "chocolate", "pretzel",
        "popcorn", "nuts", "granola bar", "trail mix", "rice cake",
    ],
    "Household & Personal": [
        "soap", "shampoo", "detergent", "paper towel", "toilet paper",
        "toothpaste", "diaper", "cleaning", "laundry", "deodorant",
        "garbage bag", "dish soap", "fabric softener",
    ],
}
TAXONOMY = [
    "Produce", "Beef", "Pork", "Poultry", "Lamb", "Seafood", "Dairy & Eggs", "Bakery", "Pantry", "Frozen", "Beverages",
    "Household & Personal", "Snacks", "Other",
]

# --- fixed values: head lines of the reports --------------------------------------
STORE_HEAD = {"hot": "🔥 Hot this week!", "solid": "✓ Solid deals", "average": "😐 Average week"}
CATEGORY_HEAD = {"great": "🔥 Great week!", "decent": "✓ Decent", "average": "😐 Average"}

# --- fixed values: food or not ---------------------------------------------------
NON_FOOD_CATEGORY_WORDS = ["household", "personal", "pet", "baby", "health"]
BABY_FOOD_WORDS = ["baby food", "formula"]
# brand, words that mean non-food, words that mean food; no hit means non-food
AMBIGUOUS_BRANDS = [
    ("dove", ["soap", "body wash", "shampoo", "deodorant", "lotion", "hair"],
     ["chocolate", "candy", "bar", "promises"]),
    ("bounty", ["paper towel", "towels", "rolls", "paper"],
     ["chocolate", "candy", "coconut", "bar"]),
]
NON_FOOD_BRANDS = {
    "personal_care": ["dove", "irish spring", "dial", "olay", "old spice", "axe", "degree",
                      "pantene", "head & shoulders", "garnier", "nivea", "aveeno", "neutrogena"],
    "oral_care": ["colgate", "crest", "oral-b", "listerine", "sensodyne"],
    "cleaning": ["tide", "gain", "downy", "lysol", "mr. clean", "windex", "swiffer", "dawn",
                 "palmolive", "cascade", "clorox"],
    "paper": ["bounty", "charmin", "cottonelle", "kleenex", "royale"],
    "baby": ["huggies", "pampers"],
    "baby_food": ["enfamil", "similac"],
    "pet": ["purina", "pedigree", "whiskas", "iams", "friskies"],
}
NON_FOOD_WORDS = [
    "shampoo", "conditioner", "body wash", "soap", "deodorant", "antiperspirant",
    "toothpaste", "toothbrush", "mouthwash", "dental", "floss",
    "laundry", "detergent", "fabric softener", "dryer sheets",
    "dish soap", "dishwasher", "cleaner", "disinfectant", "bleach",
    "paper towel", "toilet paper", "bathroom tissue", "facial tissue",
    "diaper", "wipes", "baby wipes", "training pants",
    "tampon", "pad", "panty liner", "feminine", "menstrual",
    "dog food", "cat food", "pet food", "pet treat", "kitty litter",
    "vitamin", "supplement", "medicine", "pain relief",
    "razor", "shaving", "aftershave",
    "lotion", "moisturizer", "sunscreen", "makeup", "cosmetic",
]
SNACK_WORDS = ["snack", "mini", "bite", "individual", "single", "kids", "drinkable"]
FAMILY_WORDS = ["family", "tub", "value", "bulk", "party size"]

# --- fixed values: filler words --------------------------------------------------
MATCH_SKIP_WORDS = [
    "fresh", "the", "and", "for", "with", "size", "family", "premium",
    "great", "value", "brand", "name", "new", "original",
]
DETAIL_SKIP_WORDS = ["fresh", "the", "and", "for", "with", "size", "family", "premium"]
NAME_SKIP_WORDS = [
    "fresh", "the", "and", "for", "with", "size", "family", "premium",
    "great", "value", "brand", "name", "new", "original", "pack",
    "selected", "varieties", "assorted", "flavours", "flavors",
]

# --- fixed values: display categories --------------------------------------------
DISPLAY_CATEGORIES = {
    "Meat & Protein": ["Meat", "Meat & Seafood", "Deli", "Prepared Meals", "Seafood", "Fish"],
    "Dairy & Fridge": ["Dairy", "Dairy & Eggs", "Yogurt", "Cheese", "Milk", "Butter", "Frozen"],
    "Produce": ["Produce", "Fruit", "Vegetables"],
    "Pantry & Household": ["Pantry", "Baking", "Baking Goods", "Baked Goods", "Meal Kits",
                           "Nuts & Seeds", "Canned", "Condiments"],
    "Snacks & Treats": ["Snacks", "Candy", "Sweets", "Confectionery", "Desserts", "Beverages",
                        "Chips", "Cookies"],
    "Health & Home": ["Health", "Personal Care", "Pets", "Baby", "Cleaning", "Paper"],
}

# --- fixed values: conversion factors and thresholds ------------------------------
KG_PER_LB = 0.453592
LB_PER_KG = 2.20462
GRAMS_PER_OZ = 28.3495
GRAMS_PER_OZ_SHORT = 28.35
RATING_BANDS = [(85, "🔥 Hot Deal"), (70, "✅ Good Buy"), (50, "😐 Fair"), (30, "⚠️ Below Average")]
LOWEST_RATING = "❌ Poor Value"
SIZE_BANDS = [(200, "snack"), (500, "single_serve"), (1500, "family")]
