"""Names by a lexicon: known names first, then the first phrase of the table that a name holds, with what of the rest looks like a brand or model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import collapse
from feedloom.operators.phrases import bind

# Names and phrases with their translations, in the order in which they are tried.
KNOWN = {"Pocket Hose Ballistic 100 FT": "Pocket Hose Ballistic 100 FT 伸缩花园水管", "DeliOne Duo Lock Pro": "DeliOne Duo Lock Pro 硅胶食品袋", "Avelo: Meet the world's smartest running shoe": "Avelo 跑鞋"}
KNOWN_PAIR = ("Oral-B iO Series", "toothbrush", "Oral-B iO 系列牙刷")
KNOWN_DESIGN = {
    "Bandai Built a $22 Mecha Case": "Bandai 机甲名片盒", "ZWO Seestar S50 Pro": "ZWO Seestar S50 Pro 相机包", "Urwerk Built a Hand-Carved Pocket Watch": "Urwerk 手工雕刻怀表", "Bandai Just Made the Tamagotchi a Ring": "Bandai Tamagotchi 戒指"}
PHRASES = {
    "flying trap refills": "飞虫诱捕器替换芯", "metal platform bed frame": "金属平台床架", "solid-state battery": "固态电池", "desk fan": "桌面风扇", "portable": "便携", "full length mirror": "全身镜", "ac shade": "空调遮阳罩",
    "mole repellent": "驱鼹鼠器", "grow mushrooms": "蘑菇种植套件", "multitool": "多功能工具", "keyboard": "键盘", "pants": "裤子", "chair": "椅子", "dock": "扩展坞", "tents": "帐篷", "ring": "戒指", "case": "收纳盒",
    "cordless leaf blower": "无绳吹叶机", "insulated tumbler": "保温杯", "manual can opener": "手动开罐器", "expandable garden hose": "伸缩花园水管", "garden hose": "花园水管", "silicone food bag": "硅胶食品袋", "magnetic clips": "磁吸夹",
    "fridge magnets": "冰箱磁贴", "fruit fly trap": "果蝇诱捕器", "flying insect trap": "飞虫诱捕器", "insect trap refill": "昆虫诱捕器替换芯", "watering can": "浇水壶", "window clings": "窗贴", "window stickers": "窗户贴纸",
    "dragonfly clips": "蜻蜓装饰夹", "seed packets": "种子包", "running shoe": "跑鞋", "travel toothbrush": "旅行牙刷", "toothbrush": "牙刷", "electric toothbrush": "电动牙刷", "travel headphones": "旅行耳机", "split keyboard": "分体键盘",
    "mechanical keyboard": "机械键盘", "electric kettle": "电热水壶", "travel pillow": "旅行枕", "sleeping bag": "睡袋", "smart lamp": "智能灯", "smart battery hub": "智能电池中心", "battery banks": "充电宝", "batteries & chargers": "电池与充电器",
    "battery": "电池", "multi-tool ruler": "多功能尺", "multi-tool": "多功能工具", "pocket tool": "口袋工具", "ai pen": "AI 记录笔", "litter box": "猫砂盆", "ergonomic chair": "人体工学椅", "gaming chair": "游戏椅", "pocket camera": "口袋相机",
    "panoramic camera": "全景相机", "home camera": "家用摄像头", "convertible jacket": "可转换夹克", "garment steamer": "挂烫机", "overnight oats containers": "隔夜燕麦容器", "storage drawers": "储物抽屉", "rodent repellent": "驱鼠剂",
    "mouse rodent repellent": "驱鼠剂", "air freshener spray": "空气清新喷雾", "meat thermometer": "肉类温度计", "foil shaver": "往复式剃须刀", "coffee maker": "咖啡机", "phone case": "手机壳", "camera bag": "相机包", "companion bag": "随身包",
    "duffle": "旅行袋", "backpack": "背包", "tent": "帐篷", "cot": "行军床", "scissors": "剪刀", "wallet": "钱包", "watches": "腕表", "watch": "腕表", "pillow covers": "枕套", "pillow": "枕头", "serving tray": "餐盘", "folding fan": "折叠扇",
    "food printer": "食品打印机", "inkjet printer": "喷墨打印机", "3d printer": "3D 打印机", "mower": "割草机", "vr shoes": "VR 鞋", "cutting boards": "砧板", "lunchbox": "午餐盒", "cable": "线缆收纳器", "hydrration shirt": "补水运动衫",
    "hydration shirt": "补水运动衫", "keg": "啤酒桶系统", "spray": "喷雾器",
}
HARDWARE = ["toothbrush", "litter box", "keyboard", "meat thermometer", "food printer", "portable"]
SUFFIXES = {
    "app": "应用", "application": "应用", "tool": "工具", "manager": "管理工具", "tracker": "追踪工具", "editor": "编辑器", "generator": "生成工具", "workspace": "工作区", "extension": "扩展", "server": "服务器", "viewer": "查看器",
    "recorder": "录制工具", "analyzer": "分析工具", "platform": "平台"}
NO_BRAND = ["does", "what", "why", "recommendation", "recommended", "recommend", "advice", "choosing", "new", "anyone", "looking", "from", "everybody"]
NO_SECOND = ["ultra", "luxury", "real", "digital", "titanium", "the", "built", "mechanical"]
SOFTWARE, DESIGN, PORTABLE = " 软件", " 产品设计", "便携"
HARDWARE_ZH = "牙刷|猫砂盆|键盘|温度计|打印机"
# End of the fixed values.

HAN = r"[\x{4e00}-\x{9fff}]"


def translated(name: Column) -> Column:
    """Whether a name holds a Han character."""
    return F.coalesce(name.rlike(HAN), F.lit(False))


def _first(low: Column, name: Column, phrases: dict[str, str]) -> Column:
    """(zh, before) of the first phrase of the table that stands in the name as words; null if none does."""
    hit = lambda p, zh: F.when(low.contains(p) & low.rlike(rf"\b\Q{p}\E\b"), F.struct(F.lit(zh).alias("zh"), F.regexp_extract(name, rf"(?i)^(.*?)\b\Q{p}\E\b", 1).alias("before")))
    return F.coalesce(*[hit(p, zh) for p, zh in phrases.items()])


def brand(before: Column) -> Column:
    """What of the words before a phrase looks like a brand and a model; empty if nothing does."""
    words = F.array_remove(F.split(F.regexp_replace(before, r"[^\p{L}\p{N}_+.\-]+", " "), " "), "")
    capital, digit, upper = (lambda w: w.rlike(r"^\p{Lu}")), (lambda w: w.rlike(r"\p{Nd}")), (lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"))

    def of(w: Column) -> Column:
        first, second = F.get(w, F.lit(0)), F.get(w, F.lit(1))
        joins = second.isNotNull() & ~F.lower(second).isin(*NO_SECOND) & (digit(second) | upper(second) | (upper(first) & capital(second)) | (capital(first) & capital(second)))
        pair = F.when(joins, F.array(first, second)).otherwise(F.array(first))
        model = F.get(F.reverse(F.filter(F.slice(w, 3, 1_000_000), digit)), F.lit(0))
        whole = F.when(model.isNotNull() & (F.length(model) <= 16) & ~F.array_contains(pair, F.coalesce(model, F.lit(""))), F.array_append(pair, model)).otherwise(pair)
        return (
            F.when(F.size(w) == 0, "").when(F.lower(first) == "portable", F.when(F.upper(second) == "USB", f"{PORTABLE} USB").otherwise(PORTABLE))
            .when((first == "5") & (second == "in") & (F.get(w, F.lit(2)) == "1"), "5合1").when(first.rlike(r"^\p{Nd}+$") & (second.isNull() | (F.lower(second) == "pack")), "").otherwise(F.array_join(whole, " ")))

    bare = bind(words, lambda w: F.when(F.lower(F.get(w, F.lit(0))) == "the", F.slice(w, 2, 1_000_000)).otherwise(w))
    return F.when(F.lower(F.get(words, F.lit(0))).isin(*NO_BRAND), "").otherwise(bind(bare, of))


def lexicon_name(name: Column, kind: Column) -> Column:
    """The name by the lexicon; a name of which no part is known comes back as it was (see translated())."""

    def of(own: Column) -> Column:
        low, design, software = F.lower(own), F.upper(kind) == "PRODUCT_DESIGN", F.upper(kind) == "SOFTWARE_PRODUCT"
        known = [F.when(low.contains(k.lower()), F.lit(v)) for k, v in KNOWN.items()]
        known.append(F.when(low.contains(KNOWN_PAIR[0].lower()) & low.contains(KNOWN_PAIR[1]), F.lit(KNOWN_PAIR[2])))
        known += [F.when(design & low.contains(k.lower()), F.lit(v)) for k, v in KNOWN_DESIGN.items()]
        strip = lambda x: F.regexp_replace(x, r"^[ :\-—]+|[ :\-—]+$", "")
        maker = lambda x: bind(strip(x), lambda b: F.when(b.contains(":"), F.trim(F.substring_index(b, ":", -1))).otherwise(F.coalesce(F.get(F.array_remove(F.split(b, r"\s+"), ""), F.lit(0)), F.lit(""))))
        thing = bind(_first(low, own, {p: PHRASES[p] for p in PHRASES if p in HARDWARE}), lambda m: F.when(m.isNotNull(), F.trim(F.concat_ws(" ", maker(m["before"]), m["zh"]))))
        base = F.trim(F.get(F.split(own, r"\s+[—–-]\s+|:\s+", 2), F.lit(0)))
        program = base
        for word, zh in SUFFIXES.items():
            program = F.regexp_replace(program, rf"(?i)\b{word}\b", zh)
        program = bind(program, lambda x: F.when(translated(x), x).otherwise(F.concat(base, F.lit(SOFTWARE))))
        other = bind(_first(low, own, PHRASES), lambda m: F.when(m.isNotNull(), F.trim(F.concat_ws(" ", brand(m["before"]), m["zh"]))).otherwise(own))
        drawn = bind(other, lambda x: F.when(design & ~translated(x), F.concat(own, F.lit(DESIGN))).otherwise(x))
        return F.coalesce(*known, F.when(software, F.coalesce(thing, program)), F.regexp_replace(collapse(drawn), r"^[ \-—|:]+|[ \-—|:]+$", ""))

    return bind(collapse(F.coalesce(name, F.lit(""))), of)


def lexicon_description(name_zh: Column, kind: Column, description: Column) -> Column:
    """A sentence that says no more than the kind and the name; without a translated name the description as it is."""
    own = F.upper(kind)
    return (
        F.when(~translated(name_zh), F.coalesce(description, F.lit(""))).when((own == "SOFTWARE_PRODUCT") & ~name_zh.rlike(HARDWARE_ZH), F.concat(F.lit("一款名为"), name_zh, F.lit("的软件产品。")))
        .when(own == "PRODUCT_DESIGN", F.concat(F.lit("一项名为"), name_zh, F.lit("的产品设计。"))).otherwise(F.concat(F.lit("该产品为"), name_zh, F.lit("。"))))
