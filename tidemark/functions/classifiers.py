"""Rule classifiers: ordered keyword rules kept as data, applied as one conditional column each."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: rule words, in the order in which rules are tried ----
CATEGORY_RULES = [
    ("behind_the_scenes", ["幕后", "花絮", "排练", "采访"]),
    ("sports_entertainment", ["世界杯", "足球", "球赛", "球迷", "裁判", "C罗", "姆巴佩", "哈兰德"]),
    ("creative_ai", ["AI", "ai", "ChatGPT", "二创", "漫剧", "课件"]),
    ("lifestyle", ["美食", "粽子", "端午", "龙舟", "吃喝玩乐", "水上乐园", "乐园", "酱油"]),
    ("drama_film", ["电影", "MV", "电视剧", "短剧", "昨夜将至", "芭比"]),
    ("life_emotion", ["高考", "成长", "女性力量", "治愈", "勇气", "家庭"]),
    ("entertainment_news", ["综艺", "奔跑吧", "爸爸当家", "乘风", "浪姐", "时代少年团", "时团", "男团", "韩娱", "偶像", "cp", "CP", "CORTIS", "cortis", "riize", "top登陆少年", "snh48", "SNH48"]),
    ("humor_entertainment", ["搞笑", "抽象", "整活", "笑得", "绷住", "萌娃"]),
    ("judge_comment", ["点评", "导师", "评价", "晋级", "淘汰"]),
    ("reaction", ["(?i)reaction", "反应", "观众", "全场"]),
    ("compilation", ["合集", "盘点", "混剪"]),
    ("commentary", ["声乐", "唱歌技巧", "解析", "教学", "分析"]),
    ("performance_clip", ["清唱", "无伴奏", "合唱", "副歌", "唱", "舞台"]),
    ("music_variety", ["天赐的声音", "歌手2025", "歌手2026"]),
]
HOOK_RULES = [
    ("funny", ["搞笑", "抽象", "整活", "绷住", "笑得", "萌晕"]),
    ("remix_creation", ["AI", "ai", "ChatGPT", "二创", "漫剧", "课件"]),
    ("topical_hook", ["世界杯", "足球", "端午", "高考", "热点", "出分"]),
    ("high_note", ["高音", "爆发", "力量", "唱功", "直击", "炸场"]),
    ("reaction", ["(?i)reaction"]),
    ("emotional_story", ["遗憾", "想见你", "有我呢", "靠近", "心底", "泪", "爱情故事", "成长", "勇气", "治愈", "真诚", "女性力量"]),
    ("chorus", ["副歌"]),
    ("judge_comment", ["导师", "点评", "评价"]),
]
LEAD_HOOK_RULES = [
    ("program_context_hook", ["节目上下文", "导师", "赛制", "点评", "节目"]),
    ("music_climax_hook", ["副歌", "高音", "爆点", "强节奏", "climax", "高潮"]),
    ("reaction_hook", ["现场反应", "观众", "欢呼", "哭", "泪", "惊艳"]),
    ("comment_trigger_hook", ["讨论", "是否", "为什么", "?", "？", "评论"]),
    ("story_turn_hook", ["改编", "突破", "第一次", "反转", "悬念"]),
]
#: (structure, first words, words that must come too, confidence)
STRUCTURE_RULES = [
    ("climax_first", ["一开口", "刚开口", "刚唱", "第一句", "开场", "上来就", "开口跪", "开头"], ["高音", "爆发", "炸", "燃", "惊艳", "封神"], "high"),
    ("reaction_first", ["reaction", "反应", "全场", "观众", "导师表情", "现场沸腾", "泪目"], [], "medium"),
    ("quote_first", ["这句话", "一句话", "金句", "名句", "说出", "喊话"], [], "medium"),
    ("setup_to_payoff", ["没想到", "直到", "最后", "反转", "铺垫", "导师", "点评", "晋级", "淘汰"], [], "medium"),
    ("context_first", ["第一次", "原因", "为什么", "如何", "故事", "背景", "解析", "复盘", "教程"], [], "medium"),
    ("pure_highlight", ["清唱", "无伴奏", "副歌", "爆发", "直击", "听不够", "高音", "直拍", "名场面", "舞台燃炸"], [], "medium"),
    ("linear", ["vlog", "日常", "记录", "过程", "合集", "盘点"], [], "low"),
]
ARCHETYPE_WORDS = {
    "regret_resonance": ["遗憾", "没选", "错过", "眼泪", "青春", "具体", "唱尽", "破防"],
    "stage_blast": ["高音", "转调", "炸场", "爆发", "全场", "欢呼", "起立", "燃"],
    "singer_story": ["第一次", "妈妈", "坚持", "故事", "梦想", "回忆", "成长", "压力"],
    "competition_suspense": ["排名", "晋级", "淘汰", "结果", "揭晓", "竞演", "赛制", "胜负"],
    "celebrity_pairing": ["合唱", "搭配", "默契", "合作", "组合", "互相", "共创", "同台"],
    "national_aesthetic": ["国风", "东方", "山水", "桃花", "古典", "半壶纱", "风雅", "清凉"],
    "debate_trigger": ["公平", "争议", "不服", "失误", "谁更强", "评价", "导师", "加薪"],
    "comprehensive_stage": ["歌曲", "演唱", "表演", "改编", "旋律", "情绪", "副歌", "作品"],
}
LABELS = {
    "content_category": ["unknown", "music_variety", "performance_clip", "performance_highlight", "judge_comment", "reaction", "commentary", "behind_the_scenes", "behind_scene", "entertainment_news", "humor_entertainment", "sports_entertainment", "creative_ai", "lifestyle", "drama_film", "life_emotion", "compilation", "commercial"],
    "hook_type": ["unknown", "high_note", "music_burst", "reaction", "celebrity_pairing", "emotional_story", "chorus", "judge_comment", "funny", "remix_creation", "topical_hook", "expert_comment", "daily_moment", "ecommerce"],
    "slice_structure": ["unknown", "pure_highlight", "reaction_first", "setup_to_payoff", "chorus_first", "quote_first", "climax_first", "context_first", "linear"],
}
MISSING = ["other", "none", "null", "其他", "其它"]
ALIASES = {
    "content_category": {"behind-scenes": "behind_the_scenes", "behind_scenes": "behind_the_scenes", "stage_clip": "performance_clip", "stage_highlight": "performance_highlight", "music_show": "music_variety", "music": "music_variety"},
    "hook_type": {"highnote": "high_note", "music_blast": "music_burst", "topic": "topical_hook"},
    "slice_structure": {"highlight": "pure_highlight", "setup-payoff": "setup_to_payoff", "setup_payoff": "setup_to_payoff"},
}
LEVEL_FROM = [("L7", 1_000_000), ("L6", 500_000), ("L5", 100_000), ("L4", 50_000), ("L3", 10_000), ("L2", 5_000), ("L1", 1_000)]
# ---- end of fixed values ----


def has_word(text: Column, words: list[str]) -> Column:
    """One regular expression for all words of a rule; case counts, except for words marked with ``(?i)``."""
    return text.rlike("|".join(f"(?i:{re.escape(w[4:])})" if w.startswith("(?i)") else re.escape(w) for w in words))


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str = "unknown") -> Column:
    """Name of the first rule with a word in the text."""
    text = F.coalesce(text, F.lit(""))
    out = F.lit(default)
    for name, words in reversed(rules):
        out = F.when(has_word(text, words), F.lit(name)).otherwise(out)
    return out


def category(text: Column, song: Column | None = None) -> Column:
    """Content category; a known song makes a performance of what no rule takes."""
    found = first_rule(text, CATEGORY_RULES)
    return found if song is None else F.when(found.isin("unknown", "music_variety") & (F.coalesce(song, F.lit("")) != ""), "performance_clip").otherwise(found)


def hook(text: Column) -> Column:
    return first_rule(text, HOOK_RULES)


def lead_hook(structure: Column, *more: Column) -> Column:
    """Hook of the first leg of a structure text, else of all the texts together."""
    lead = first_rule(F.trim(F.element_at(F.split(F.coalesce(structure, F.lit("")), "->"), 1)), LEAD_HOOK_RULES)
    rest = first_rule(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (*more, structure)]), LEAD_HOOK_RULES)
    return F.when(lead != "unknown", lead).otherwise(rest)


def structure(text: Column) -> Column:
    """struct(structure, confidence, evidence): the first rule whose words are there, and the first such word."""
    text = F.coalesce(text, F.lit(""))
    shape = "struct<structure:string,confidence:string,evidence:string>"
    out = F.struct(F.lit("unknown"), F.lit("low"), F.lit("")).cast(shape)
    for name, words, also, sure in reversed(STRUCTURE_RULES):
        hit = F.try_element_at(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), F.lower(w))), F.lit(1))
        fits = hit.isNotNull() & (has_word(text, also) if also else F.lit(True))
        out = F.when(fits, F.struct(F.lit(name), F.lit(sure), hit).cast(shape)).otherwise(out)
    return out


def archetype(text: Column, hook_type: Column) -> Column:
    """Archetype: overriding words and hooks, else the most keywords, the first of equals; none: the general one."""
    low, h = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.trim(F.coalesce(hook_type, F.lit(""))))
    extra = {"national_aesthetic": (["国风", "东方", "半壶纱"], 2), "stage_blast": (["副歌", "高音", "全场"], 1)}
    scores = []
    for i, (name, words) in enumerate(ARCHETYPE_WORDS.items()):
        n = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        if name in extra:
            n = n + F.when(has_word(low, extra[name][0]), extra[name][1]).otherwise(0)
        scores.append(F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")))
    best = F.greatest(*scores)
    named = F.when(h.isin("high_note", "music_burst", "stage_blast", "高音爆点"), "stage_blast").when(h.isin("emotional_story", "情绪故事"), "singer_story").when(h.isin("celebrity_pairing", "明星组合"), "celebrity_pairing")
    over = F.when(has_word(low, ["遗憾", "没选", "错过"]), "regret_resonance").when(has_word(low, ["国风", "东方", "半壶纱", "桃花", "风雅"]), "national_aesthetic")
    return F.coalesce(over, named, F.when(best["n"] > 0, best["name"]), F.lit("comprehensive_stage"))


def confidence(item_id: Column, tags: Column, count: Column, *evidence: Column) -> Column:
    """high, medium or low by how much of a work is known."""
    n = sum((e.cast("int") for e in evidence), F.lit(0))
    some = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    return F.when(some(item_id) & some(tags) & (n >= 3), "high").when(some(item_id) | some(tags) | some(count) | (n >= 1), "medium").otherwise("low")


def normal_label(field: str, value: Column) -> tuple[Column, Column]:
    """(label, reason) of a semantic field: aliases resolved, anything else unknown with why."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    key = F.regexp_replace(F.lower(raw), r"\s+", "_")
    mapped = key
    for alias, name in {**ALIASES[field], **dict.fromkeys(MISSING, "unknown")}.items():
        mapped = F.when(key == alias, F.lit(name)).otherwise(mapped)
    is_label = mapped.isin(LABELS[field])
    label = F.when(is_label, mapped).otherwise(F.lit("unknown"))
    reason = F.when(raw == "", "missing").when(~is_label, F.concat(F.lit("unmapped:"), F.substring(raw, 1, 40))).when((mapped == "unknown") & (key != "unknown"), "missing_or_unknown").otherwise("")
    return label, reason


def view_level(views: Column) -> Column:
    out = F.lit("L0")
    for name, least in reversed(LEVEL_FROM):
        out = F.when(views >= least, F.lit(name)).otherwise(out)
    return out
