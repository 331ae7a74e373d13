"""Own sentence pools of the corpus generator. Placeholders in braces may name others; they are filled in three passes."""

from __future__ import annotations

COMPANIES = ("The Company", "We", "The Group", "Our subsidiaries", "The Registrant", "{name}")
NAMES = ("Alder Mills", "Birchfield Corp", "Cedar Point Foods", "Dunmore Steel", "Elm Street Bank", "Foxglove Energy")
SUBJECTS = {"ir": "interest rate", "fx": "foreign currency", "cp": "{commodity} price", "eq": "equity price", "gen": "market"}
INSTRUMENTS = ("swap agreements", "forward contracts", "option contracts", "collars", "futures contracts", "swaptions")
COMMODITIES = ("natural gas", "diesel fuel", "copper", "wheat", "aluminum", "coffee")
CURRENCIES = ("euro", "yen", "Canadian dollar", "pound sterling", "Swiss franc")
MONTHS = ("March", "June", "September", "December")

POSITIONS = {
    "curr": ("As of {month} {day}, {year}, {company} held {instrument} with {figure}", "At year end {year}, {company} had outstanding {instrument} with {figure}", "{company} is party to {instrument} that mature in {later}, with {figure}"),
    "hist": ("In {earlier}, {company} held {instrument} with {figure}", "During {earlier}, {company} settled {instrument} with {figure}", "{company} had {instrument} that expired in {earlier}, with {figure}"),
    "spec": ("{company} may in the future enter into {instrument}", "{company} could use {instrument} if conditions warrant", "From time to time {company} may consider {instrument}"),
}
FIGURES = ("a notional amount of ${amount} million", "a fair value of ${amount} million", "notional amounts of ${amount} million and ${amount2} million in {year} and {earlier}")
CONNECTORS = ("compared with", "against", "versus")
RESULTS = {
    "gen": ("gains of ${amount} million were recorded in earnings", "the ineffective portion was not material"),
    "ir": ("interest expense was reduced by ${amount} million",),
    "fx": ("exchange losses were reduced by ${amount} million",),
    "cp": ("cost of sales rose by ${amount} million",),
    "eq": ("compensation cost fell by ${amount} million",),
}
MITIGATIONS = ("to reduce the effect of {subject} changes", "to limit its exposure to {subject} risk", "to fix part of its {subject} cost")

EXPOSURES = {
    "ir": ("{company} has ${amount} million of variable rate debt outstanding.", "A change of one point in rates would alter interest expense by ${amount} million.", "Borrowings under the credit facility bear interest at a floating rate."),
    "fx": ("{company} has sales in the {currency} and is exposed to its movements.", "About {share}% of revenue is earned outside the country.", "Our results are affected by the {currency}."),
    "cp": ("{company} buys {commodity} and is exposed to its price.", "A rise of ten percent in the price of {commodity} would cost ${amount} million.", "The cost of {commodity} is a large part of our expense."),
    "eq": ("{company} holds listed shares worth ${amount} million.", "The value of our investments follows the stock market."),
    "gen": ("{company} is exposed to market risk.", "Market conditions may affect our results."),
}
EXPIRIES = {"curr": ("These contracts expire in {later}.", "The {instrument} mature in {month} {later}."), "hist": ("All of them expired in {earlier}.", "None was outstanding at the end of {year}.")}
PAYMENTS = ("{company} pays a fixed rate and receives a floating one.", "Under these contracts {company} paid ${amount} million in {year}.", "Settlements are made each {quarter}.")
POLICIES = ("{company} does not hold derivatives for trading.", "Hedge accounting is applied where its conditions are met.", "Changes in fair value are recorded in other comprehensive income.", "The board reviews the hedging policy every year.")
POLICY_UPDATES = ("In {year} new guidance on hedge accounting was adopted.", "The effect of the new standard was not material.")

EXTRAS = {
    "warr": {
        "curr": ("Warrants to buy {count} shares at ${price} were outstanding at {month} {day}, {year}.", "The warrant liability had a fair value of ${amount} million at year end {year}.", "The warrants are carried as a liability and expire in {later}."),
        "hist": ("Warrants issued in {earlier} were exercised for {count} shares.", "All warrants expired unexercised in {earlier}.", "The warrant liability of ${amount} million was settled in {earlier}."),
    },
    "emb": {
        "curr": ("The convertible notes contain an embedded derivative with a fair value of ${amount} million.", "The conversion feature is bifurcated and marked to market at {month} {day}, {year}.", "Embedded derivatives in supply contracts are worth ${amount} million."),
        "hist": ("The embedded derivative was extinguished in {earlier} when the notes were converted.", "In {earlier} the conversion feature lapsed and ${amount} million was released to earnings."),
    },
}
TOPICS = {
    "topic0": ("The audit committee met {few} times in {year}.", "Fees paid to the auditor were ${amount} million."),
    "topic1": ("Rent expense was ${amount} million in {year}.", "The leases run until {later} and may be renewed."),
    "topic2": ("The plan covers {count} employees.", "Pension cost was ${amount} million in {year}."),
    "topic3": ("Goodwill is tested every year.", "An impairment of ${amount} million was recorded in {year}."),
    "topic4": ("Deferred tax assets were ${amount} million.", "The effective tax rate was {share}%."),
    "topic5": ("Inventories are stated at the lower of cost and market.", "Finished goods were ${amount} million at year end."),
}
FILING = ("Commission file number {file}.", "Indicate by check mark whether the registrant is a shell company.", "Annual report pursuant to section 13 for the fiscal year ended {month} {day}, {year}.", "Item {few}. Properties ........ {share}", "The aggregate market value held by non-affiliates was ${amount} million.", "Documents incorporated by reference: none.")
ACCOUNTING = ("Revenue is recognized when goods are delivered.", "Property is depreciated over {few} to {share} years.", "Cash equivalents mature within three months.", "Use of estimates is required.", "Certain amounts of {earlier} have been reclassified.")

BARGAINING = {
    "coverage": ("About {share}% of our employees are covered by collective bargaining agreements", "Many of our employees belong to labor unions", "{union} represents {count} of our workers"),
    "no_coverage": ("None of our employees is represented by a union", "We are not party to any collective bargaining agreement"),
    "risk": ("A strike could harm our operations", "Work stoppages at our plants {where} would raise our costs", "Union organizing may increase our labor cost"),
    "international": ("Our employees {where} are represented by {union}", "Works councils represent our staff {where}"),
    "us_only": ("Our employees {where} are covered by an agreement with {union}", "Only workers {where} are members of {union}"),
    "adversarial": ("Until {earlier} some employees belonged to a union", "If our employees chose a union, costs could rise", "The employees of our suppliers are unionized"),
    "irrelevant": ("Our headquarters has {few} floors", "We sold {count} units in {year}"),
    "relations": ("We consider our employee relations to be good", "There has been no strike since {earlier}"),
    "expiry": ("The agreement expires in {month} {later}", "Agreements covering {share}% of them end in {later}"),
    "talks": ("Talks on a new agreement began in {month} {year}",),
}
INTROS = ("Human capital. ", "Our people. ")
PLACES = {"us": ("in the United States", "in Ohio", "in Texas"), "international": ("in Germany", "in Mexico", "abroad"), "generic": ("at several sites",)}
UNIONS = {"us": ("the United Millworkers", "a national union in Ohio"), "international": ("a works council", "IG Holz"), "generic": ("a labor union",)}
