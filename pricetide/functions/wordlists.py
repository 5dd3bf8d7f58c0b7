"""Fixed values that name parsing and matching depend on.

Everything in this module is data: word lists, phrase tables, patterns and
thresholds whose exact value decides the result.
"""

# Spelling variants replaced as whole phrases, applied in this order.
PHRASE_ALIASES = (
    ("jw", "johnnie walker"),
    ("etiqueta negra", "black label"),
    ("etiqueta roja", "red label"),
    ("etiqueta azul", "blue label"),
    ("etiqueta dorada", "gold label"),
    ("etiqueta oro", "gold label"),
    ("etiqueta verde", "green label"),
    ("johnny walker", "johnnie walker"),
    ("jhonnie walker", "johnnie walker"),
    ("jack daniel s", "jack daniels"),
    ("jack daniel", "jack daniels"),
    ("j b", "jb"),
    ("six pack", "pack 6"),
)

# The same for search text.
SEARCH_PHRASE_ALIASES = (
    ("etiqueta negra", "black label"),
    ("etiqueta roja", "red label"),
    ("etiqueta azul", "blue label"),
    ("etiqueta dorada", "gold label"),
    ("etiqueta oro", "gold label"),
    ("etiqueta verde", "green label"),
    ("johnny walker", "johnnie walker"),
    ("jhonnie walker", "johnnie walker"),
    ("johnie walker", "johnnie walker"),
    ("jack daniel s", "jack daniels"),
    ("jack daniel", "jack daniels"),
    ("jw", "johnnie walker"),
    ("j w", "johnnie walker"),
)

# Single-token spelling variants.
TOKEN_ALIASES = {
    "whiskey": "whisky",
    "anejo": "aneho",
    "litre": "litro",
    "lts": "litro",
    "lt": "litro",
}

# Words that say nothing about which product it is.
GENERIC_WORDS = (
    "whisky whiskey vino vinos ron rones gin vodka tequila pisco licor licores "
    "espumante espumantes cerveza cervezas botella botellas lata latas unidad unidades "
    "un u oferta ofertas promo promocion descuento precio especial formato contenido "
    "alcohol grado grados ml cc cl litro litros pack caja case estuche"
).split()

# Words left out of the normalized key.
KEY_STOP_WORDS = (
    "whisky whiskey vino ron gin vodka tequila licor espumante botella"
).split()

# Words left out of search text.
SEARCH_STOP_WORDS = (
    "comprar precio precios oferta ofertas barato barata botella unidad unidades "
    "formato contenido"
).split()

# Tokens that tell variants of one product apart.
VARIANT_MARKERS = (
    "black red blue gold green double honey apple fire cinnamon orange cherry blanco "
    "silver reposado aneho reserva gran premium select especial original zero sin"
).split()

# Brands recognised as a phrase; longer phrases win, then alphabetical.
KNOWN_BRANDS = sorted(
    (
        "johnnie walker", "jack daniels", "chivas regal", "ballantines", "buchanans",
        "glenfiddich", "glenlivet", "jameson", "jim beam", "wild turkey", "makers mark",
        "absolut", "smirnoff", "grey goose", "bombay sapphire", "tanqueray", "beefeater",
        "hendricks", "bacardi", "havana club", "captain morgan", "jose cuervo",
        "don julio", "alto del carmen", "pisco mistral", "mistral", "capel",
        "el gobernador", "santa rita", "concha y toro", "casillero del diablo",
        "marques de casa concha", "miguel torres", "veuve clicquot", "moet chandon",
    ),
    key=lambda brand: (-brand.count(" "), brand),
)

# Name patterns (case-insensitive where used).
VOLUME_PATTERN = r"(\d+(?:[.,]\d+)?)\s*(ml|cc|cl|l|lt|lts|litro|litros)\b"
ABV_PATTERN = r"(\d{1,2}(?:[.,]\d+)?)\s*(?:%\s*(?:alc\.?|vol\.?)?|°|grados?)"
VINTAGE_PATTERN = r"\b(19\d{2}|20\d{2})\b"
PRICE_IN_NAME_PATTERN = r"\$\s*[\d.]+"
PERCENT_IN_NAME_PATTERN = r"-?\d+(?:[.,]\d+)?\s*%"
PACK_WORD_PATTERN = r"\b(pack|caja|case|sixpack|estuche|combo)\b"
BUNDLE_PATTERN = (
    r"\b(regalo|incluye|copa|vaso|jigger|miniatura|personalizad[oa]s?|grabada?|grabado)\b"
    r"|(\+|\by\b)\s*\d*\s*(agua|bebida|tonica|red bull|copa|vaso)"
)
PACK_COUNT_PATTERNS = (
    r"\b(?:pack|caja|case|combo)\s*(?:de\s*)?(\d{1,2})\b",
    r"\b(\d{1,2})\s*(?:unidades|unidad|uds|ud|u)\b",
    r"\b(\d{1,2})\s*[x×]\s*\d+(?:[.,]\d+)?\s*(?:ml|cc|cl|l|lt|lts)\b",
    r"\b(\d{1,2})\s+botellas?\b",
    r"\b(\d{1,2})\s+latas?\b",
)
MULTIPLIER_PATTERNS = (r"\b[x×]\s*(\d{1,2})\b", r"\b(\d{1,2})\s*[x×](?:\s|$)")
MULTIPLIER_COUNTS = (2, 3, 4, 5, 6, 8, 10, 12, 15, 18, 20, 24, 30, 36, 48)

# Names that are no names.
BAD_NAMES = ("", "null", "none", "n/a", "na", "producto", "product", "sin nombre", "undefined")

# Category markers, first category with a hit wins.
CATEGORY_RULES = (
    ("Whisky", ("whisky", "whiskey", "bourbon", "scotch")),
    ("Espumantes", ("espumante", "champagne", "prosecco", "sparkling", "brut")),
    ("Cervezas", ("cerveza", "beer", "lager", " ale ", " ipa ")),
    ("Gin", ("gin", "ginebra")),
    ("Vodka", ("vodka",)),
    ("Ron", ("ron", " rum ")),
    ("Piscos", ("pisco",)),
    ("Tequila", ("tequila", "mezcal")),
    ("Licores", ("licor", "liqueur", "vermouth", "aperitivo", "bitter", "amaro",
                 "cognac", "coñac", "brandy", "sake")),
    ("Vinos", ("vino", " wine ", "cabernet", "carmenere", "carménère", "merlot", "syrah",
               "chardonnay", "sauvignon", "pinot", "malbec", "ensamblaje")),
)
ACCESSORY_MARKERS = (
    "accesorio", "sacacorcho", "saca corcho", "copa ", "copas ", "vaso ", "vasos ",
    "decantador", "aireador", "gift card", "tarjeta de regalo", "bolsa de regalo",
)
RELEVANT_WORDS = (
    "whiskey", "whisky", "vino", "espumante", "cerveza", "gin", "pisco", "destilado",
    "ron", "tequila", "vodka", "licor", "coctel", "cocktail", "pack", "sour",
)
IRRELEVANT_WORDS = ("bebida", "energetica", "sin alcohol", "cafe")

# Words of a page that is a notice instead of a catalog.
NOTICE_MARKERS = (
    "volveremos pronto", "maintenance center", "sitio en mantenimiento",
    "estamos en mantenimiento", "cf-chl-", "challenge-platform", "captcha",
    "access denied", "temporarily unavailable", "robot challenge screen", "sgcaptcha",
)

# Words that count as "another product" inside a polluted title.
PRODUCT_NOUNS = ("vino", "vinos", "whisky", "pisco", "ron", "gin", "vodka", "tequila")
PERSONALISED_PATTERN = (
    r"\b(personalizad[oa]s?|personalizalo|personalízalo|graba(?:do)?|grabada)\b"
)

# Matching methods.
TRUSTED_METHODS = (
    "manual_equivalence", "ean_exact", "sku_brand_volume_exact", "sku_secondary_verified",
)
EXACT_METHODS = ("alias_exact", "ean_exact", "sku_secondary_verified", "manual_equivalence")
VETO_METHODS = ("excluded_pack", "volume_conflict", "vintage_conflict", "abv_conflict")

# Tie order of price contexts, cheapest first.
CONTEXT_PRIORITY = {"MEMBER": 0, "SALE": 1, "PUBLIC": 2, "CARD_PROMO": 3, "COUPON": 4}
DEFAULT_AUDIENCES = ("cav_member",)
