"""Words by which a transcript's texts give cues."""

# ---- fixed values: cue words, audience words and the words of advertisements ----
CUE_WORDS = {
    "context": ["导师", "评委", "老师", "点评", "没想到", "第一次", "最后", "直接", "竟然", "为什么", "突破", "淘汰", "晋级", "改编"],
    "suspense": ["淘汰", "晋级", "待定", "排名", "票数", "结果", "选择", "PK", "pk", "对决", "赛制", "悬念", "复活", "争议"],
    "story": ["故事", "经历", "一路", "小时候", "家人", "妈妈", "父亲", "写给", "压力", "梦想", "坚持", "原创", "练习"],
    "music": ["副歌", "高音", "转调", "和声", "rap", "RAP", "爆发", "高潮", "开口跪", "长音", "哭腔", "升key", "真假音", "solo", "drop", "炸场", "炸場", "炸裂"],
    "reaction": ["全场", "观众", "现场", "掌声", "欢呼", "尖叫", "起立", "站起来", "拍手", "泪目", "哭了", "哽咽", "导师反应", "评委反应", "反应"],
}
AUDIENCE = ["观众", "觀眾", "全场", "全場", "现场", "現場", "掌声", "掌聲", "欢呼", "歡呼", "尖叫", "起立", "泪目", "淚目", "眼泪", "眼淚", "哭了", "流泪", "流淚", "哽咽", "感动", "感動"]
SPONSORS = [
    "合作伙伴", "合作夥伴", "超级合作伙伴", "超級合作夥伴", "提醒您", "提醒你", "销量第一", "銷量第一", "怕上火", "广告", "廣告", "VIP", "vivo", "王老吉", "白雀羚", "欧丽薇兰", "欧利威兰", "動感地帶", "动感地带", "芒果卡", "盲國卡", "盲国卡",
    "歌手听我唱", "歌手聽我唱", "合唱官", "扫码", "掃碼", "直播间", "直播間", "直拍", "QQ音乐", "QQ音樂", "网易云", "網易雲", "汽水音乐", "汽水音樂", "酷狗", "酷我", "酸酸乳", "蒙牛", "猛流酸酸乳", "官方帐号", "官方帳號", "参与互动", "參與互動", "登录", "登入", "收听", "收聽",
]
# ---- end of fixed values ----
