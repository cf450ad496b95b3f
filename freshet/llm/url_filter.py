"""URL filter: block and allow rules by host and path, and for all other urls a logistic regression.

Method: host and path are cut into character n-grams, which are hashed into a fixed number of weights; a
logistic regression is fitted to a small labelled url table and judges every url that no rule fits.

Cases: a null url, or one without "://", has an empty host and path; no rule fits it, and a url without any
n-gram is allowed; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import bounded_broadcast, plain

#: log2 of the number of weights; lengths of n-grams; bytes of rules and weights that are broadcast at most.
WEIGHT_BITS, GRAMS, MODEL_BOUND = 16, (3, 4, 5), 64_000_000
BATCH = 4096

#: The small labelled table: urls that are to be blocked, and urls that are to be allowed.
BLOCKED = """
https://www.casino-royal-bonus.example.com/slots/free-spins?ref=88
http://bestpokeronline.example.net/signup.php?aff=1204
https://free-bets-today.example.org/football/odds/tips.html
http://jackpot-winners.example.com/claim/prize/2019
https://play.megaslots777.example.net/games/roulette-live
http://lottery-results-win.example.org/numbers/buy-ticket
https://bingo-cash.example.com/promo/no-deposit-bonus
http://www.betting-exchange.example.net/en/blackjack/
https://cheap-viagra-pills.example.com/order/no-prescription
http://online-pharmacy-discount.example.org/cialis/buy-now.html
https://buy-xanax-cheap.example.net/cart?item=tramadol
http://weightloss-pills.example.com/miracle-diet/keto-burn
https://steroids-shop.example.org/anabolic/stack
http://replica-watches-outlet.example.com/rolex/cheap
https://fake-designer-bags.example.net/louis/replica-sale.html
http://xxx-videos-tube.example.com/porn/free/hd/5521
https://www.adultcams.example.org/live/girls?tag=nude
http://hot-escorts.example.net/city/escort-girls/
https://sexdating-tonight.example.com/meet/singles-near-you
http://nude-celebs.example.org/gallery/xxx/12.jpg
https://milf-hookup.example.net/join-free
http://erotic-massage-ads.example.com/listing/881
https://payday-loans-fast.example.org/apply/no-credit-check
http://instant-cash-advance.example.com/quick-loan/approval
https://debt-relief-now.example.net/consolidate?aff=77
http://forex-profit-robot.example.com/signals/earn-daily
https://crypto-doubler.example.org/invest/bitcoin-x2
http://make-money-home.example.net/work-from-home/secret-system
https://get-rich-quick.example.com/mlm/opportunity
http://click.ad-tracker.example.net/redirect?url=offer&cid=991
https://ads.popunder-network.example.com/banner/serve.js?zone=3
http://trk.affiliate-clicks.example.org/go.php?offer=22&sub=x
https://pixel.adserver.example.net/imp?cb=827331
http://track.emailblast.example.com/unsubscribe/click?id=55
https://doubleclick-ads.example.org/adview/728x90
http://warez-downloads.example.com/crack/photoshop-keygen.exe
https://torrent-movies-free.example.net/download/full-hd-rip
http://serial-keys.example.org/activation/windows-crack.zip
https://nulled-scripts.example.com/plugins/premium-nulled.rar
http://free-iptv-streams.example.net/m3u/premium-list
https://stream-sports-free.example.org/watch/live-hd-now
http://hack-tools.example.com/wifi-password-cracker/apk
https://mod-apk-unlimited.example.net/coins/generator
http://free-giftcard-generator.example.org/claim/codes
https://spam-link-directory.example.com/submit/backlinks/buy
http://seo-backlinks-cheap.example.net/package/10000-links
https://article-spinner.example.org/auto/blog-posts
http://essay-writing-cheap.example.com/buy-essay/discount
https://fake-diploma.example.net/order/degree
http://psychic-readings-love.example.org/call-now/free-minutes
https://prize-claim-urgent.example.com/verify/account-login
http://secure-bank-verify.example.net/login.php?session=suspended
https://update-your-account.example.org/paypal/confirm/password
http://win-free-iphone.example.com/survey/complete
https://lucky-winner-gift.example.net/spin/wheel?aff=5
http://cheap-tickets-scam.example.org/deal/limited-offer
https://penny-auction-win.example.com/bid/now
http://male-enhancement.example.net/trial/free-bottle
https://botox-cheap-online.example.org/order/fillers
http://vape-wholesale-discount.example.com/bulk/cheap-juul
https://www.casino-win.example.org/en/100.html
http://casino-night.example.com/fr/897
https://blog.free-bets.example.net/de/1694/
https://m.bets-online.example.com/es/2491?page=2
http://cheap-pills.example.org/en/3288#top
https://www.pills-direct.example.org/en/4085.html
http://spam-farm.example.com/fr/4882
https://blog.farm-links.example.net/de/5679/
https://m.ads-track.example.com/es/6476?page=2
http://track-ads.example.org/en/7273#top
https://www.adult-x.example.org/en/8070.html
http://adult-zone.example.com/fr/8867
https://blog.poker-win.example.net/de/664/
https://m.slots-free.example.com/es/1461?page=2
http://lottery-win.example.org/en/2258#top
https://www.viagra-shop.example.org/en/3055.html
http://xxx-tube.example.com/fr/3852
https://blog.payday-loans.example.net/de/4649/
https://m.warez-free.example.com/es/5446?page=2
http://click-ads.example.org/en/6243#top
https://www.jackpot-win.example.org/en/7040.html
http://replica-shop.example.com/fr/7837
https://blog.escort-girls.example.net/de/8634/
https://m.crack-keys.example.com/es/431?page=2
http://porn-free.example.org/en/1228#top
https://www.popup-ads.example.org/en/2025.html
http://betting-tips.example.com/fr/2822
https://blog.free-spins.example.net/de/3619/
https://m.link-spam.example.com/es/4416?page=2
http://adult-cams.example.org/en/5213#top
"""
ALLOWED = """
https://www.city-library.example.org/catalogue/search?q=history
https://museum.example.com/exhibitions/2021/impressionists
http://www.primary-school.example.net/parents/term-dates.html
https://news.example.org/2020/05/12/council-approves-budget
https://en.wiki.example.com/wiki/Photosynthesis
https://docs.example.net/api/v2/reference/authentication
http://recipes.example.org/soups/tomato-basil
https://www.weather.example.com/forecast/edinburgh/tomorrow
https://blog.travelnotes.example.net/2018/07/hiking-in-norway
http://journal.biology.example.org/article/10.1000/482
https://university.example.edu/departments/mathematics/courses
https://forum.gardening.example.com/t/pruning-roses/2214
https://health.example.gov/conditions/asthma/treatment
http://parks.example.gov/trails/map.pdf
https://code.example.org/project/issues/341
https://shop.bookstore.example.com/fiction/new-releases
https://photos.example.net/albums/summer-2016/41
http://www.church.example.org/services/sunday
https://music.example.com/artists/string-quartet/tour
https://sports.example.net/football/results/2019-03-02
https://archive.example.org/texts/letters-1862/page/14
http://railway.example.com/timetable/north-line
https://theatre.example.net/season/hamlet/tickets
https://science.example.org/physics/gravity-waves-explained
https://www.bakery.example.com/menu/bread
https://localnews.example.net/community/school-fair
http://farmers-market.example.org/stalls/vegetables
https://translate.example.com/de/woerterbuch/haus
https://www.radio.example.net/programmes/morning-show/listen
http://astronomy.example.org/observations/jupiter.html
https://kids.example.com/stories/the-brave-fox
https://law.example.gov/statutes/chapter-12/section-4
https://energy.example.org/solar/how-panels-work
http://www.orchestra.example.net/concerts/spring
https://software.example.com/downloads/release-notes/3.2
https://maps.example.org/region/lake-district
https://economics.example.net/papers/inflation-2008.pdf
http://cycling-club.example.com/rides/saturday
https://help.example.org/articles/reset-a-device
https://www.hotel.example.net/rooms/family?lang=fr
https://zoo.example.com/animals/penguin-colony
http://language.example.org/grammar/verbs/irregular
https://election.example.gov/results/ward/7
https://charity.example.org/about/annual-report
https://painting.example.net/lessons/watercolour-sky
http://www.dentist.example.com/opening-hours
https://history.example.org/timeline/bronze-age
https://films.example.net/reviews/the-long-winter
https://water.example.gov/quality/river-report
http://chess.example.com/openings/sicilian-defence
https://poetry.example.org/anthology/nature/14
https://kitchen.example.net/how-to/sharpen-a-knife
https://geology.example.com/rocks/granite
http://nursery.example.org/children/admissions
https://www.airport.example.net/departures/terminal-2
https://statistics.example.gov/population/census-2011
https://fishing.example.com/guides/trout-season
http://birdwatch.example.org/species/kingfisher
https://philosophy.example.net/essays/on-reason
https://woodwork.example.com/projects/oak-table
https://www.news-page.example.org/en/100.html
http://library-books.example.com/fr/897
https://blog.school.example.net/de/1694/
https://m.museum.example.com/es/2491?page=2
http://garden.example.org/en/3288#top
https://www.weather.example.org/en/4085.html
http://travel.example.com/fr/4882
https://blog.science.example.net/de/5679/
https://m.history.example.com/es/6476?page=2
http://music.example.org/en/7273#top
https://www.sports.example.org/en/8070.html
http://health.example.com/fr/8867
https://blog.theatre.example.net/de/664/
https://m.journal.example.com/es/1461?page=2
http://archive.example.org/en/2258#top
https://www.station.example.org/en/3055.html
http://winter.example.com/fr/3852
https://blog.letter.example.net/de/4649/
https://m.mother.example.com/es/5446?page=2
http://brother.example.org/en/6243#top
https://www.thunder.example.org/en/7040.html
http://weather-north.example.com/fr/7837
https://blog.theory.example.net/de/8634/
https://m.author.example.com/es/431?page=2
http://nation.example.org/en/1228#top
https://www.render.example.org/en/2025.html
http://shoe-shop.example.com/fr/2822
https://blog.path-finder.example.net/de/3619/
https://m.eastern.example.com/es/4416?page=2
http://winter-trip.example.org/en/5213#top
"""


def built_in_labels() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 if it is to be blocked)."""
    return [(url, bad) for bad, urls in ((1, BLOCKED), (0, ALLOWED)) for url in urls.split()]


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    after = rest[end:]
    stop = min((i for i in map(after.find, "?#") if i >= 0), default=len(after))
    host = rest[:end]
    return (host.lower() if host.isascii() else "".join(c.lower() if c.isascii() else c for c in host)), after[:stop]


class Rules:
    """Rules by host; each fits its host and all subdomains where the path starts with the rule's."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        for found in self.by_host.values():
            found.sort(key=lambda x: -len(x[1]))

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[str, str] | None = None
        while host:
            for start, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(start):
                    if best is None or len(rule) > len(best[0]):
                        best = rule, verdict
                    break
            host = host.partition(".")[2]
        return best


def hashed_grams(parts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, weight number) of every n-gram of the hosts and paths."""
    texts = [x for host, path in parts for x in (f"^{host}$" if host else "", f"^{path}$" if path else "")]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    rows, numbers = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        value = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            value = value * np.uint64(0x100000001B3) + codes[j : len(codes) - n + 1 + j]
        first = text[: len(value)]
        inside = first == text[n - 1 :]
        value = (value[inside] * np.uint64(2) + (first[inside] % 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        rows.append(first[inside] // 2)
        numbers.append((value >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(numbers)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def margins(parts: list[tuple[str, str]], weights: np.ndarray, bias: float) -> np.ndarray:
    """The log-odds that a url is unwanted; below every threshold where there is no n-gram."""
    rows, numbers = hashed_grams(parts)
    n = np.bincount(rows, minlength=len(parts))
    total = np.bincount(rows, weights=weights[numbers], minlength=len(parts))
    return np.where(n > 0, total / np.sqrt(np.maximum(n, 1)) + bias, -np.inf)


def fit(labelled: list[tuple[str, int]], rounds: int = 1500, step: float = 2.0, decay: float = 1e-5, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent with momentum; the same rows give the same weights. ``prior``: the share of
    urls to be blocked where the method is used, if it is not the labelled table's; it moves the intercept."""
    parts, y = [host_and_path(u) for u, _ in labelled], np.asarray([b for _, b in labelled], float)
    weights, bias = np.zeros(1 << WEIGHT_BITS), 0.0
    if not len(y):
        return weights, bias
    rows, numbers = hashed_grams(parts)
    each = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(parts)), 1))
    speed, bias_speed = np.zeros_like(weights), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(each * np.bincount(rows, weights=weights[numbers], minlength=len(parts)) + bias))) - y
        slope = np.bincount(numbers, weights=(error * each)[rows], minlength=len(weights)) / len(y) + decay * weights
        speed, bias_speed = 0.9 * speed - step * slope, 0.9 * bias_speed - step * error.mean() * 0.1
        weights, bias = weights + speed, bias + bias_speed
    if prior is not None and 0 < y.mean() < 1:
        bias += math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
    return weights, bias


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, threshold: float = 0.5, prior: float | None = 0.2, most_labelled: int = 20_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``score`` (the
    method's probability that the url is to be blocked, for a share of ``prior`` of such urls; null: as in the table). ``labelled`` (url, label 0/1) defaults to the built-in
    table; of a larger table the ``most_labelled`` rows with the least hash are used."""
    spark: SparkSession = pages.sparkSession
    if labelled is None:
        known = built_in_labels()
    else:
        known = [(r.url, int(r.label)) for r in plain(labelled, url="url", label="label").where("label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(most_labelled).collect()]
    weights, bias = fit(known, prior=prior)
    model = bounded_broadcast(spark, (rules, weights.astype(np.float32), bias), weights.nbytes // 2 + sum(len(r) + len(v) for r, v in rules), MODEL_BOUND, "the rules and weights")
    rows = plain(pages, page_id=id_col, url=url_col)
    kind = rows.schema["page_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, weights, bias = model.value
        held = Rules(listed)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                some = batch.slice(start, BATCH)
                parts = [host_and_path(u) for u in some.column(1).to_pylist()]
                scores = 1 / (1 + np.exp(-np.clip(margins(parts, weights, bias), -700, 700)))
                found = [held.longest(*x) for x in parts]
                verdicts = [f[1] if f else "block" if s >= threshold else "allow" for f, s in zip(found, scores)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([f and f[0] for f in found], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
