"""Vocabulary and weights of the domain, and lexicons built from them.

The tables below are fixed values: results depend on each entry.  Everything
that uses them takes a :class:`Lexicon`, so another vocabulary can be given.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

# Fixed values, in their natural order.

EVENT_TYPES = (
    "exploit", "governance", "listing", "funding", "token_unlock", "airdrop", "partnership", "merger", "incentive_program", "market_structure",
    "institutional_adoption", "product_launch", "macro", "unknown",
)

CHAINS = ("solana", "base", "ethereum", "bitcoin", "arbitrum", "optimism", "polygon", "bnb chain", "avalanche")

EVENT_IMPORTANCE = {
    "exploit": 0.18, "governance": 0.12, "product_launch": 0.12, "institutional_adoption": 0.12, "listing": 0.10, "funding": 0.10,
    "token_unlock": 0.10, "incentive_program": 0.09, "market_structure": 0.08, "airdrop": 0.10, "partnership": 0.08, "merger": 0.08, "macro": 0.08,
}

TOKENS = {
    "BTC": ["btc", "bitcoin"], "ETH": ["eth", "ethereum"], "SOL": ["sol", "solana"], "JUP": ["jup", "jupiter"], "HYPE": ["hype", "hyperliquid"],
    "ARB": ["arb", "arbitrum"], "OP": ["op", "optimism"], "BNB": ["bnb", "binance coin", "bnb chain"], "AVAX": ["avax", "avalanche"],
    "WIF": ["wif", "dogwifhat"], "BONK": ["bonk"], "ENA": ["ena", "ethena"], "ONDO": ["ondo"], "MKR": ["mkr", "maker"], "AAVE": ["aave"],
}

PROJECTS = {
    "Bitcoin": ["bitcoin", "btc"], "Ethereum": ["ethereum", "eth"], "Solana": ["solana", "sol"], "Base": ["base", "base chain", "coinbase l2"],
    "Jupiter": ["jupiter", "jup"], "Hyperliquid": ["hyperliquid", "hype"], "Arbitrum": ["arbitrum", "arb"], "Optimism": ["optimism", "op mainnet"],
    "Polygon": ["polygon", "matic", "polygon pos"], "BNB Chain": ["bnb chain", "binance smart chain", "bsc"], "Avalanche": ["avalanche", "avax"],
    "Ethena": ["ethena", "ena"], "Ondo": ["ondo", "ondo finance"], "Aave": ["aave"], "Maker": ["maker", "makerdao", "sky"], "Drift": ["drift"],
    "Kamino": ["kamino"], "Raydium": ["raydium", "ray"], "Pump.fun": ["pump.fun", "pumpfun"], "dogwifhat": ["dogwifhat", "wif"], "Bonk": ["bonk"],
    "Kraken": ["kraken"], "Coinbase": ["coinbase"], "Binance": ["binance"],
}

TOPICS = {
    "DeFi": ["defi", "dex", "amm", "yield", "lending", "perp", "perpetual"],
    "AI Agents": ["ai agents", "ai agent", "agent", "autonomous agent"],
    "NFT": ["nft", "ordinal", "ordinals"],
    "Governance": ["governance", "proposal", "vote", "snapshot"],
    "Airdrop": ["airdrop", "claim", "retroactive"],
    "Exploit": ["exploit", "hack", "drain", "breach"],
    "Listing": ["listing", "listed", "open trading", "trading starts", "上线交易", "上架交易", "登陆交易所"],
    "Funding": ["raise", "funding", "financing", "seed round", "series a", "series b", "strategic round", "融资", "募资"],
    "Memecoin": ["memecoin", "meme coin", "meme", "dog token"],
    "Token Unlock": ["token unlock", "unlocks", "vesting", "cliff", "解锁", "归属"],
    "Partnership": ["partnership", "collaboration", "partnered", "合作", "integrates with", "集成"],
    "Merger": ["acquire", "acquisition", "merge", "merger", "收购", "合并"],
    "Incentive Program": ["reward program", "points program", "launchpool", "liquidity incentive", "mining campaign", "积分计划", "激励计划", "流动性激励"],
    "Restaking": ["restaking", "liquid restaking", "lrt", "eigenlayer"],
    "Stablecoin": ["stablecoin", "stables", "usdt", "usdc", "susde"],
    "RWA": ["rwa", "real world asset", "tokenized treasury", "treasury tokenization"],
    "Derivatives": ["derivatives", "futures", "options", "perps", "open interest"],
    "Layer2": ["layer2", "layer 2", "l2", "rollup", "optimistic rollup"],
}

MACRO = (
    "fed", "fomc", "powell", "cpi", "ppi", "inflation", "rate cut", "rate hike", "nonfarm", "payroll", "tariff", "trade deficit", "treasury",
    "bond yield", "liquidity", "recession", "risk-on", "risk-off", "美联储", "非农", "通胀", "加息", "降息", "关税", "贸易逆差", "国债收益率",
    "流动性", "衰退",
)

NOISE = (
    "大使馆", "以色列", "伊朗", "沙特", "无人机", "空袭", "军事", "战争", "袭击", "embassy", "israel", "iran", "saudi", "missile", "drone",
    "airstrike", "military",
)

TEXT_RULES = {
    "exploit": ["exploit", "hack", "drain", "breach", "攻击", "被盗", "漏洞", "security incident"],
    "governance": ["proposal", "vote", "governance", "提案", "投票", "治理", "snapshot"],
    "listing": ["listing", "listed", "open trading", "trading starts", "上线交易", "上架交易", "登陆币安", "登陆交易所"],
    "funding": ["raise", "funding", "financing", "seed round", "series a", "series b", "strategic round", "融资", "募资"],
    "token_unlock": ["token unlock", "unlocks", "vesting", "cliff", "解锁", "归属"],
    "airdrop": ["airdrop", "claim", "retroactive", "空投", "领取", "申领"],
    "partnership": ["partnership", "collaboration", "partnered", "合作", "integrates with", "集成"],
    "merger": ["acquire", "acquisition", "merge", "merger", "收购", "合并"],
    "incentive_program": ["reward program", "points program", "launchpool", "liquidity incentive", "mining campaign", "积分计划", "激励计划", "流动性激励"],
    "market_structure": ["open interest", "liquidation", "short squeeze", "etf flow", "whale transfer", "funding rate", "清算", "爆仓", "鲸鱼转账", "资金费率"],
}

TITLE_HINTS = {"market_structure": ["surge", "rally", "跌破", "突破"]}
TOPIC_OVERRIDES = {"Derivatives": "market_structure"}
#: Event type -> keywords, names of which one is required (none: not asked), boost.
CONTEXT_BOOSTS = {
    "institutional_adoption": (
        ["现货交易", "spot trading", "提供交易", "支持交易", "开放交易", "计划推出", "plans to launch", "considering offering", "考虑推出", "考虑提供"],
        ["嘉信理财", "schwab", "fidelity", "blackrock", "coinbase", "binance", "okx"],
        0.70,
    ),
    "product_launch": (["launch", "announced", "release", "mainnet", "推出", "主网上线", "goes live", "live now"], [], 0.55),
}
#: Entity present -> what a started score of these types gains.
PRESENCE = {
    "tokens": {"listing": 0.10, "token_unlock": 0.12},
    "projects": {"funding": 0.10, "partnership": 0.08, "merger": 0.08, "product_launch": 0.10, "governance": 0.08, "incentive_program": 0.08},
}

#: Aliases that count in some contexts only: phrases that veto, phrases that decide, word pairs within 20 characters.
GUARDED = {
    "agent": (
        [],
        ["ai agents", "ai agent", "agent skills", "agentic", "autonomous agent", "onchain agent", "on-chain agent"],
        [(r"\bagent\b", r"\bai\b"), (r"\bai\b", r"\bagent\b"), (r"\bagent\b", r"\bwallet\b"), (r"\bagent\b", r"\bon[- ]?chain\b")],
    ),
    "yield": (
        ["treasury yield", "bond yield", "yield curve", "10-year yield", "2-year yield"],
        ["yield farming", "yield farm", "yield-bearing", "yield vault", "defi yield", "staking yield", "lending yield"],
        [(r"\byield\b", r"\bfarm"), (r"\byield\b", r"\bdefi\b"), (r"\byield\b", r"\blending\b"), (r"\byield\b", r"\bstaking\b")],
    ),
}

#: Candidates that are never kept, by category; suffixes and rewrites of candidate keys.
CANDIDATE_NOISE = {
    "project": [r"\b(skill|founder|ceo|cto|kol)\b", r"(联合创始人|联创|创始人|同事)"],
    "token": [r"(多单|空单|交易对|trading pair)"],
    "topic": [r"\bskill\b", r"(联合创始人|联创|创始人|同事)", r"(多单|空单|清算强度|清算图|爆仓图)"],
    "event_keyword": [r"\bskill\b", r"(赛季|第[一二三四五六七八九十0-9]+期|行动)", r"\b(pre-?tge|s[0-9]+)\b"],
}
PROJECT_SUFFIXES = (r"\s*平台$", r"\s*账户$", r"\s*account$", r"\s*trading$")
EVENT_REWRITES = ((r"\bhack incident\b", "hack"), (r"\bincident\b", ""), (r"\s+事件$", ""))
SMALL_WORDS = ("and", "or", "of", "the", "to")
ACRONYMS = ("ETF", "FUD", "TVL", "MVRV", "ETH", "BTC", "USDT")
CATEGORIES = ("project", "token", "topic", "event_keyword")


@dataclass(frozen=True)
class Lexicon:
    projects: dict[str, list[str]] = field(default_factory=lambda: dict(PROJECTS))
    tokens: dict[str, list[str]] = field(default_factory=lambda: dict(TOKENS))
    topics: dict[str, list[str]] = field(default_factory=lambda: dict(TOPICS))
    chains: tuple[str, ...] = CHAINS
    macro: tuple[str, ...] = MACRO
    noise: tuple[str, ...] = NOISE
    rules: dict[str, list[str]] = field(default_factory=lambda: dict(TEXT_RULES))
    hints: dict[str, list[str]] = field(default_factory=lambda: dict(TITLE_HINTS))
    overrides: dict[str, str] = field(default_factory=lambda: dict(TOPIC_OVERRIDES))
    boosts: dict[str, tuple] = field(default_factory=lambda: dict(CONTEXT_BOOSTS))

    def overlaid(self, overlay: dict) -> Lexicon:
        """With the aliases of an exported vocabulary; event keywords in it are not used."""
        return replace(
            self,
            projects=merged(self.projects, overlay.get("entity_aliases") or {}),
            tokens=merged(self.tokens, overlay.get("token_aliases") or {}),
            topics=merged(self.topics, overlay.get("topic_aliases") or {}),
        )

    def rows(self) -> list[tuple[str, str, str, int, int]]:
        """(bucket, canonical, alias, place of the canonical, place of the alias)."""
        tables = {"projects": self.projects, "tokens": self.tokens, "chains": {c.title(): [c] for c in self.chains}, "topics": self.topics}
        return [(b, c, a, i, j) for b, t in tables.items() for i, (c, aliases) in enumerate(t.items()) for j, a in enumerate(aliases)]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "bucket string, canonical string, alias string, canonical_ord int, alias_ord int")

    def reference(self) -> list[tuple[str, str, list[str]]]:
        """The vocabulary as (category, canonical, aliases) rows."""
        tables = {"project": self.projects, "token": self.tokens, "topic": self.topics}
        return [(k, c, list(a)) for k, t in tables.items() for c, a in t.items()] + [("event_keyword", e, []) for e in EVENT_TYPES[:-1]]

    def known_keys(self) -> list[tuple[str, str]]:
        """(category, key) of everything a candidate must not repeat."""
        found = {(k, x.lower().strip()) for k, c, aliases in self.reference() for x in (c, *aliases) if x.strip()}
        return sorted(found)


def merged(base: dict[str, list[str]], more: dict[str, list[str]]) -> dict[str, list[str]]:
    """Aliases that are new, trimmed, after those there are; a new name only with at least one."""
    out = {k: list(v) for k, v in base.items()}
    for name, aliases in more.items():
        new = [a for a in dict.fromkeys(x.strip() for x in aliases or [] if x and x.strip()) if a not in out.get(name, [])]
        if new:
            out.setdefault(name, []).extend(new)
    return out


def read_overlay(spark: SparkSession, path: str | None) -> dict:
    """The exported vocabulary at ``path``; nothing if it is missing or no JSON object."""
    if not path:
        return {}
    try:
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        found = json.loads(text)
    except Exception:  # a missing path is an AnalysisException, a bad file a ValueError: both mean no overlay
        return {}
    return found if isinstance(found, dict) else {}
