"""Word lists, weights and score tables the results depend on."""

from __future__ import annotations

# English stop words dropped before TF-IDF.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "for", "on", "with", "as", "by", "at", "is", "was",
    "are", "were", "be", "been", "this", "that", "these", "those", "it", "its", "they", "them", "their", "we",
    "our", "you", "your", "he", "his", "she", "her", "will", "would", "can", "could", "may", "might", "should",
    "shall", "has", "have", "had", "do", "does", "did", "not", "no", "if", "then", "than", "so", "just", "also",
    "from", "into", "over", "out", "up", "down", "off", "about", "after", "before", "between", "during", "more",
    "less", "most", "least", "very", "much", "many", "some", "any", "all", "each", "every", "one", "two", "three",
    "other", "another", "i", "me", "my",
)

# Source credibility, first matching substring wins.
SOURCE_CREDIBILITY = (
    ("coindesk", 0.95), ("bitcoin magazine", 0.95), ("cointelegraph", 0.90), ("decrypt", 0.85), ("the block", 0.85),
    ("cryptoslate", 0.80), ("coingecko", 0.80), ("newsbtc", 0.75), ("u.today", 0.70), ("rss", 0.65),
    ("reddit", 0.55), ("twitter", 0.50), ("unknown", 0.50),
)
DEFAULT_CREDIBILITY = 0.50

# Words that make a headline price-relevant.
PRICE_KEYWORDS = (
    "bitcoin", "btc", "price", "rally", "dump", "crash", "surge", "drop",
    "etf", "institution", "grayscale", "blackrock", "microstrategy",
    "sec", "cftc", "ban", "approved", "regulation", "legal",
    "whale", "accumulate", "exchange", "liquidation", "funding rate",
    "inflation", "fed", "interest rate", "recession", "fomc",
    "halving", "upgrade", "fork", "lightning",
)

# Weights (recency, credibility, keywords) and half-life in hours per horizon.
RELEVANCE_WEIGHTS = {
    "15m": (0.75, 0.15, 0.10, 0.5),
    "1h": (0.60, 0.20, 0.20, 2.0),
    "4h": (0.45, 0.30, 0.25, 6.0),
    "24h": (0.30, 0.35, 0.35, 12.0),
}

# Fixed values: (look-back minutes, number kept) per horizon.
SELECTION = {"15m": (30, 3), "1h": (60, 4), "4h": (240, 5), "24h": (1440, 8)}
CANDIDATES = {"15m": (1440, 16), "1h": (1440, 16), "4h": (5760, 32), "24h": (10080, 32)}

# Topic words of the crawler's filter.
TOPIC_KEYWORDS = (
    "bitcoin", "btc", "ethereum", "eth", "crypto", "cryptocurrency", "blockchain", "binance", "bnb", "solana", "sol",
    "cardano", "ada", "ripple", "xrp", "dogecoin", "doge", "polkadot", "dot", "avalanche", "avax", "polygon", "matic",
    "defi", "nft", "web3", "altcoin", "stablecoin", "usdt", "usdc", "mining", "wallet", "exchange", "token", "coin",
    "satoshi", "halving", "bull market", "bear market",
)

# Words behind the relevance score of an extracted article.
CRYPTO_WORDS = (
    "bitcoin", "btc", "ethereum", "eth", "crypto", "blockchain", "binance", "coinbase", "defi", "nft", "altcoin",
    "token", "solana", "sol", "bnb", "doge", "dogecoin", "xrp", "ripple", "fed", "federal reserve", "interest rate",
    "inflation", "cpi", "sec", "regulation", "etf", "halving", "whale", "liquidation",
    "tài sản mã hóa", "tiền mã hóa", "tiền điện tử", "sàn giao dịch",
)
HIGH_IMPACT_WORDS = (
    "cấp phép", "giấy phép", "phê duyệt", "hợp pháp hóa", "thí điểm", "license", "approval", "legalize", "etf",
    "sec approval", "institutional adoption", "regulatory", "government", "central bank",
    "ngân hàng trung ương", "chính phủ", "bộ tài chính", "quy định",
)

# Sentiment words; the "very" lists count twice.
VERY_POSITIVE = (
    "cấp phép", "phê duyệt", "hợp pháp hóa", "thông qua", "chấp thuận", "approval", "approved", "legalize",
    "adoption", "breakthrough", "ath", "all-time high", "moon", "bullrun",
)
POSITIVE = (
    "tăng", "surge", "bullish", "rally", "gain", "profit", "breakout", "soar", "tích cực", "lạc quan", "tăng trưởng",
    "phát triển", "mở rộng", "tiềm năng", "rise", "growth", "expand", "potential", "opportunity", "buy", "accumulation",
)
VERY_NEGATIVE = (
    "scam", "hack", "fraud", "bankruptcy", "ban", "cấm", "lừa đảo", "phá sản", "crash", "collapse", "sụp đổ",
)
NEGATIVE = (
    "giảm", "bearish", "dump", "plunge", "drop", "fall", "decline", "loss", "tiêu cực", "lo ngại", "rủi ro",
    "cảnh báo", "suy giảm", "correction", "sell", "liquidation", "fear", "panic", "warning", "risk", "concern",
)

# Substring to symbol.
SYMBOL_WORDS = (
    ("bitcoin", "BTCUSDT"), ("btc", "BTCUSDT"), ("ethereum", "ETHUSDT"), ("eth", "ETHUSDT"), ("ether", "ETHUSDT"),
    ("solana", "SOLUSDT"), ("sol", "SOLUSDT"), ("bnb", "BNBUSDT"), ("binance coin", "BNBUSDT"), ("binance", "BNBUSDT"),
    ("dogecoin", "DOGEUSDT"), ("doge", "DOGEUSDT"), ("xrp", "XRPUSDT"), ("ripple", "XRPUSDT"), ("cardano", "ADAUSDT"),
    ("ada", "ADAUSDT"), ("avalanche", "AVAXUSDT"), ("avax", "AVAXUSDT"), ("polkadot", "DOTUSDT"), ("dot", "DOTUSDT"),
    ("polygon", "POLUSDT"), ("matic", "POLUSDT"), ("pol", "POLUSDT"),
)
DEFAULT_SYMBOL = "BTCUSDT"

# Whole words to symbol; the names match in any case, the tickers in capitals only.
SYMBOL_PATTERNS = (
    ("BTCUSDT", ("bitcoin",), ("BTC",)), ("ETHUSDT", ("ethereum", "ether"), ("ETH",)),
    ("BNBUSDT", ("binance coin",), ("BNB",)), ("SOLUSDT", ("solana",), ("SOL",)), ("XRPUSDT", ("ripple",), ("XRP",)),
    ("DOGEUSDT", ("dogecoin",), ("DOGE",)), ("ADAUSDT", ("cardano",), ("ADA",)),
    ("AVAXUSDT", ("avalanche",), ("AVAX",)), ("DOTUSDT", ("polkadot",), ("DOT",)),
    ("POLUSDT", ("polygon", "matic"), ("POL",)),
)

# The factor ontology, in index order.
FACTORS: dict[str, tuple[str, ...]] = {
    "institutional_inflow": (
        "institution", "fund", "grayscale", "microstrategy", "blackrock", "corporate", "treasury", "bitcoin purchase",
        "acquisition", "buy", "accumul", "pension", "endowment", "sovereign", "wealth fund", "purchased", "invested",
        "allocat"),
    "etf_flow": (
        "etf", "spot etf", "bitcoin etf", "sec approval", "inflow", "outflow", "etf listing", "issuance",
        "bitcoin fund", "crypto fund", "futures etf", "bitcoin trust", "grayscale premium", "discount", "nav"),
    "regulatory_easing": (
        "approved", "legal", "regulatory clarity", "compliant", "licensed", "framework", "clearance", "authorize",
        "regulation", "bill", "congress", "law", "policy", "guidance", "exemption", "sandbox", "pilot"),
    "regulatory_tightening": (
        "ban", "crackdown", "illegal", "sanction", "sec sue", "enforcement", "restrict", "prohibited", "suspension",
        "warning", "probe", "investigation", "fine", "penalty", "delist", "cbdc", "kyc", "aml"),
    "exchange_risk": (
        "hack", "exploit", "exchange down", "withdrawal halt", "insolvent", "ftx", "celsius", "rug", "compromised",
        "security", "breach", "stolen", "loss", "bankrupt", "withdrawal", "freeze", "halted", "suspicious"),
    "liquidity_squeeze": (
        "liquidity", "leverage", "liquidation", "margin call", "funding rate", "squeeze", "cascade", "deleverag",
        "short squeeze", "long squeeze", "open interest", "perp", "futures", "basis", "contango", "backwardation"),
    "whale_accumulation": (
        "whale", "transaction", "on-chain", "address", "wallet", "accumulate", "hodl", "large buy", "holdings",
        "large transaction", "miner", "mining", "cold storage", "staking", "hodler", "accumulation", "supply"),
    "macro_uncertainty": (
        "inflation", "fed", "interest rate", "recession", "gdp", "cpi", "fomc", "yield", "economy", "growth",
        "rate hike", "rate cut", "bank", "dollar", "usd", "dxy", "treasury", "bonds", "stock market", "equity"),
    "protocol_upgrade": (
        "upgrade", "fork", "halving", "taproot", "merge", "protocol", "layer2", "lightning", "launch", "update",
        "mainnet", "testnet", "snapshot", "airdrop", "defi", "nft", "smart contract", "validator", "node"),
    "network_outage": (
        "outage", "congestion", "fees spike", "mempool", "hash rate", "51%", "network issue", "downtime", "slow",
        "backlog", "stuck", "unconfirmed", "difficulty", "block time", "hashpower", "reorg"),
}
FACTOR_NAMES = tuple(FACTORS)
DEFAULT_FACTOR = FACTOR_NAMES.index("macro_uncertainty")

# Extra weight of a source per factor index, first matching substring wins.
SOURCE_PRIORS = (
    ("bloomberg", {7: 0.25}), ("reuters", {7: 0.25}), ("wsj", {7: 0.20}), ("cnbc", {7: 0.20}),
    ("financial times", {7: 0.25}), ("marketwatch", {7: 0.20}), ("cointelegraph", {0: 0.15, 1: 0.15}),
    ("coindesk", {0: 0.15, 1: 0.15}), ("decrypt", {0: 0.10, 8: 0.10}), ("bitcoin magazine", {8: 0.20}),
    ("newsbtc", {6: 0.15}), ("coingecko", {1: 0.10, 6: 0.10}), ("reddit", {4: 0.10}), ("rss", {}),
)
LABEL_TEMPERATURE = 0.5
TITLE_WEIGHT = 3

# Source tiers of the corpus credibility map.
TIER_ONE = (
    "coindesk", "cointelegraph", "theblock", "the block", "decrypt", "bloomberg", "reuters", "wsj",
    "wall street journal", "financial times", "ft.com", "cnbc", "bitcoinmagazine", "forbes", "blockworks",
)
TIER_TWO = (
    "cryptoslate", "cryptonews", "newsbtc", "cryptopotato", "u.today", "utoday", "beincrypto", "bein crypto",
    "coinmarketcap", "cryptobriefing", "ambcrypto", "cryptodaily", "coingape", "bitcoinist", "trustnodes",
    "cryptopanic",
)
TIER_ONE_SCORE, TIER_TWO_SCORE, UNKNOWN_CAP, UNKNOWN_DEFAULT = 0.9, 0.7, 0.6, 0.3

# Titles of failed downloads.
BAD_TITLES = (
    "error 500", "server error", "that’s an error", "that's an error", "page not found", "404 not found",
    "access denied",
)
MIN_TITLE, MIN_CONTENT = 10, 100

# Links the crawler ignores and path parts it follows.
LINK_EXCLUDE = ("/tag/", "/category/", "/login", "/register", "/search", "/about", ".pdf")
LINK_FOLLOW = ("/news/", "/article/", ".html", "-", "/202", "/market/", "/finance/")

# Neutral band of the direction label per horizon.
EPSILON = {"15m": 0.001, "1h": 0.002, "4h": 0.005, "24h": 0.010}
EPSILON_RANGE = (1e-4, 5e-2)

# Texts of explanations.
DIRECTION_TEXT = {0: "giảm", 1: "đi ngang", 2: "tăng", -1: "giảm"}
FACTOR_TEXT = {
    "institutional_inflow": "dòng tiền tổ chức", "etf_flow": "dòng tiền ETF", "regulatory_easing": "nới lỏng quy định",
    "regulatory_tightening": "siết chặt quy định", "exchange_risk": "rủi ro sàn giao dịch",
    "liquidity_squeeze": "siết thanh khoản", "whale_accumulation": "tích lũy của cá voi",
    "macro_uncertainty": "bất định vĩ mô", "protocol_upgrade": "nâng cấp giao thức", "network_outage": "sự cố mạng lưới",
}

# Frequent fragments of the test texts, so that every branch of a keyword operator is reached in tests.
TEST_FACTORS: dict[str, tuple[str, ...]] = {
    "endings": ("tion", "ing", "edan"), "articles": ("the", "der "), "joins": ("and", "und "), "vowels": ("ea", "ou"),
    "rare": ("zzz",),
}
