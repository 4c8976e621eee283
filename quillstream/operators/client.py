"""Rules of the reporting client as DataFrame operators (JN4, STR8 to STR10, STR12, FLT7 to FLT12, FN27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

OTHER = "其他"
#: Which applications an activity stands for, in the order of precedence.
ACTIVITY_GROUPS = (
    ("在工作&研究", ("com.apple.iWork.Pages", "com.apple.iWork.Numbers", "com.apple.iWork.Keynote", "com.microsoft.Word", "com.microsoft.Excel", "com.microsoft.Powerpoint", "com.microsoft.onenote.mac", "com.microsoft.Outlook", "com.microsoft.teams", "com.electron.lark", "com.volcengine.corplink", "com.raycast.macos", "cn.trae.app", "com.trae.app", "com.microsoft.OneDrive")),
    ("在搞研发", ("com.microsoft.VSCode", "com.sublimetext.3", "com.apple.dt.Xcode", "com.SweetScape.010Editor", "me.qii404.another-redis-desktop-manager", "cn.apifox.app", "com.todesktop.230313mzl4w4u92", "com.jetbrains.goland", "com.jetbrains.toolbox", "com.mongodb.compass", "com.electron.ollama", "io.podmandesktop.PodmanDesktop", "com.postmanlabs.mac")),
    ("在设计", ("com.bohemiancoding.sketch3", "com.figma.Desktop", "com.adobe.Photoshop")),
    ("在开会", ("us.zoom.xos", "com.tinyspeck.slackmacgap")),
    ("在浏览", ("com.apple.Safari", "com.google.Chrome", "org.mozilla.firefox", "com.brave.Browser", "com.operasoftware.Opera", "company.thebrowser.Browser", "com.microsoft.edgemac", "com.vivaldi.Vivaldi")),
    ("在终端", ("com.apple.Terminal", "com.googlecode.iterm2", "com.googlecode.iterm2.iTermAI", "com.termius-dmg.mac")),
    ("在娱乐", ("com.bytedance.douyin.desktop", "com.soda.music", "com.xingin.discover", "com.meituan.imovie", "com.netease.163music", "com.tencent.QQMusicMac", "com.spotify.client", "com.apple.Music", "com.aspiro.tidal")),
    ("在社交", ("com.tencent.qq", "ru.keepcoder.Telegram", "com.hnc.Discord", "net.whatsapp.WhatsApp", "com.tencent.xinwei.mac")),
)
#: Keywords of each category of activity, in the order of precedence.
CATEGORIES = (
    ("development", ("研发", "开发", "编程", "代码", "写代码", "coding", "programming", "develop")),
    ("work", ("工作", "办公", "研究", "学习", "阅读")),
    ("design", ("设计", "design")),
    ("meeting", ("会议", "讨论", "开会", "meeting")),
    ("browsing", ("浏览", "上网", "browse", "browsing")),
    ("terminal", ("终端", "terminal", "命令行", "shell")),
    ("entertainment", ("娱乐", "游戏", "音乐", "视频", "entertainment")),
    ("social", ("社交", "聊天", "通讯", "social", "chat")),
    ("rest", ("休息", "休闲", "idle", "空闲")),
)
#: Close codes after which a client doesn't connect again.
STOP_CODES = (1006, 1008, 1013, 4401, 4403)
BLOCK_STOP_CODES = (1008, 1013, 4401, 4403)


def group_table(spark: SparkSession, groups: tuple = ACTIVITY_GROUPS, disabled: tuple[str, ...] = ()) -> DataFrame:
    """(bundle_id, label): the first enabled group of each application."""
    first: dict[str, str] = {}
    for label, ids in groups:
        if label not in disabled:
            for x in ids:
                first.setdefault(x, label)
    return spark.createDataFrame(sorted(first.items()), "bundle_id string, label string")


def with_activity_label(df: DataFrame, groups: DataFrame) -> DataFrame:
    """df (bundle_id) with `label`. The groups are a setting of at most a few hundred rows."""
    return df.join(F.broadcast(groups), "bundle_id", "left").withColumn("label", F.coalesce("label", F.lit(OTHER)))


def category(label: Column) -> Column:
    low = F.lower(label)
    out = F.when(label.isNull(), "other")
    for name, words in CATEGORIES:
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w)
        out = out.when(found, name)
    return out.otherwise("other")


def _previous(column: str) -> Column:
    return F.lag(column).over(W.Window.partitionBy("user_id").orderBy("seq"))


def song_reports(updates: DataFrame) -> DataFrame:
    """updates (user_id, seq, music) with `reported`: a song with the title and artist of the one before isn't
    reported, nor is a stop."""
    same = F.col("_before").isNotNull() & (F.col("_before.title") == F.col("music.title")) & (F.col("_before.artist") == F.col("music.artist"))
    return updates.withColumn("_before", _previous("music")).withColumn("reported", F.col("music").isNotNull() & ~F.coalesce(same, F.lit(False))).drop("_before")


def label_reports(activities: DataFrame) -> DataFrame:
    """activities (user_id, seq, label) with `reported`: only labels that differ from the one before."""
    return activities.withColumn("reported", ~F.coalesce(_previous("label") == F.col("label"), F.lit(False)))


def cpu_usage(ticks: DataFrame) -> DataFrame:
    """ticks (user_id, seq, user_ticks, system_ticks, nice_ticks, idle_ticks) with `cpu`: the used share since the
    sample before; null for the first and where no tick has passed."""
    d = {c: F.col(f"{c}_ticks") - _previous(f"{c}_ticks") for c in ("user", "system", "nice", "idle")}
    used = d["user"] + d["system"] + d["nice"]
    total = used + d["idle"]
    return ticks.withColumn("cpu", F.when(total > 0, used / total))


def valid_media(title: Column, artist: Column) -> Column:
    return F.coalesce((F.length(title) > 0) & (F.length(artist) > 0), F.lit(False))


def allowed_player(bundle_id: Column, allowed: tuple[str, ...]) -> Column:
    """Only a known player that isn't on a list with entries is refused."""
    return bundle_id.isNull() | (bundle_id.isin(*allowed) if allowed else F.lit(True))


def music_empty(music: Column) -> Column:
    return (F.coalesce(music["ts"], F.lit(0)) == 0) | (F.coalesce(music["title"], F.lit("")) == "")


def activity_empty(activity: Column) -> Column:
    return (F.coalesce(activity["ts"], F.lit(0)) == 0) | (F.coalesce(activity["label"], F.lit("")) == "")


def system_empty(system: Column) -> Column:
    return F.coalesce(system["ts"], F.lit(0)) == 0


def search_apps(apps: DataFrame, text: str, selected: tuple[str, ...]) -> DataFrame:
    """apps (name, bundle_id) that contain the text, selected ones first, then by name; with their `position`."""
    found = apps
    if text:
        found = apps.where(F.lower("name").contains(text.lower()) | F.lower("bundle_id").contains(text.lower()))
    chosen = F.col("bundle_id").isin(*selected) if selected else F.lit(False)
    # The list of running applications of one machine: one window is enough.
    order = W.Window.orderBy(F.desc("selected"), F.lower("name"), "bundle_id")
    return found.withColumn("selected", chosen).withColumn("position", F.row_number().over(order))


def config_error(endpoint: Column, system_interval: Column, activity_interval: Column) -> Column:
    """What is wrong with a configuration; null if nothing is."""
    return (
        F.when(F.coalesce(endpoint, F.lit("")) == "", "服务器地址不能为空")
        .when(endpoint.rlike("[\\s<>\"{}|\\\\^`]"), "服务器地址格式无效")
        .when((system_interval < 5) | (system_interval > 300), "系统轮询间隔必须在 5-300 秒之间")
        .when((activity_interval < 1) | (activity_interval > 300), "活动轮询间隔必须在 5-60 秒之间")
    )


def stops_reconnecting(code: Column, block: bool = False) -> Column:
    return code.isin(*(BLOCK_STOP_CODES if block else STOP_CODES))


def backoff(spark: SparkSession, first_ms: float = 1000.0, jitter_ms: float = 0.0, factor: float = 1.8, most_ms: float = 30_000.0, attempts: int = 10) -> DataFrame:
    """(attempt, delay_ms) of a client that connects again and again."""
    base = F.least(F.lit(most_ms), F.lit(first_ms) * F.pow(F.lit(factor), F.col("attempt") - 1))
    return spark.range(1, attempts + 1).select(F.col("id").cast("int").alias("attempt")).withColumn("delay_ms", F.least(base + F.lit(jitter_ms), F.lit(most_ms)))


def report_totals(reports: DataFrame) -> DataFrame:
    """(user_id, reports, last_ms): a client's counter and the time of its last report."""
    return reports.groupBy("user_id").agg(F.count("*").alias("reports"), F.max("arrival_ms").alias("last_ms"))


def socket_reply(kind: Column) -> Column:
    """What the server answers to a message: PING with PONG, SNAPSHOT with the current state; others are only logged."""
    return F.when(kind == "PING", "PONG").when(kind == "SNAPSHOT", "SNAPSHOT").otherwise("IGNORED")


def debounced(changes: DataFrame, quiet_ms: int = 100) -> DataFrame:
    """changes (user_id, seq, at_ms) with `applied`: only a change that none follows within quiet_ms counts (STR13)."""
    following = F.lead("at_ms").over(W.Window.partitionBy("user_id").orderBy("at_ms", "seq"))
    return changes.withColumn("applied", following.isNull() | (following - F.col("at_ms") >= quiet_ms))


HEARTBEAT_MS, READ_TIMEOUT_MS = 10_000, 60_000


def socket_sessions(messages: DataFrame) -> DataFrame:
    """messages (connection_id, seq, at_ms, kind) with `reply`, `heartbeats` and `closed`.

    The first message of a connection finds the welcome (a PONG) sent. The server sends a heartbeat every HEARTBEAT_MS:
    `heartbeats` counts those since the message before. A connection that is silent for more than READ_TIMEOUT_MS is closed:
    what comes after has no reply, nor are heartbeats sent.
    """
    w = W.Window.partitionBy("connection_id").orderBy("at_ms", "seq")
    opened = F.first("at_ms").over(w)
    before = F.lag("at_ms").over(w)
    m = messages.withColumns({"_late": F.coalesce(F.col("at_ms") - before > READ_TIMEOUT_MS, F.lit(False)), "_sent": F.floor((F.col("at_ms") - opened) / HEARTBEAT_MS), "_welcome": before.isNull()})
    m = m.withColumns({"closed": F.max("_late").over(w), "_beats": F.col("_sent") - F.coalesce(F.lag("_sent").over(w), F.lit(0))})
    reply = F.when(F.col("closed"), F.lit(None)).when(F.col("_welcome"), F.concat(F.lit("PONG,"), socket_reply(F.col("kind")))).otherwise(socket_reply(F.col("kind")))
    beats = F.when(F.col("closed"), 0).otherwise(F.col("_beats")).cast("long")
    return m.withColumns({"reply": reply, "heartbeats": beats}).drop("_late", "_sent", "_welcome", "_beats")


def subscriber_gauges(subscriptions: DataFrame) -> DataFrame:
    """(users, clients): how many users are watched, and by how many clients (AGG10)."""
    return subscriptions.agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("clients"))
