"""Names of places: countries by region, other spellings, and names of regions."""

from __future__ import annotations

from .geo import Places

# Countries by region, in alphabetical order.
COUNTRIES = {
    "Africa": "Algeria, Angola, Benin, Botswana, Burkina Faso, Burundi, Cameroon, Cape Verde, Central African Republic, Chad, Comoros, Congo, Côte d’Ivoire, Djibouti, DR Congo, Egypt, Equatorial Guinea, Eritrea, Eswatini, Ethiopia, Gabon, Gambia, Ghana, Guinea, Guinea-Bissau, Kenya, Lesotho, Liberia, Libya, Madagascar, Malawi, Mali, Mauritania, Mauritius, Morocco, Mozambique, Namibia, Niger, Nigeria, Rwanda, Sao Tome and Principe, Senegal, Seychelles, Sierra Leone, Somalia, South Africa, South Sudan, Sudan, Tanzania, Togo, Tunisia, Uganda, Zambia, Zimbabwe",
    "South Asia": "Afghanistan, Bangladesh, Bhutan, India, Maldives, Nepal, Pakistan, Sri Lanka",
    "East Asia": "China, Hong Kong, Japan, Macau, Mongolia, North Korea, South Korea, Taiwan",
    "Southeast Asia": "Brunei, Cambodia, Indonesia, Laos, Malaysia, Myanmar, Philippines, Singapore, Thailand, Timor-Leste, Vietnam",
    "Central Asia": "Kazakhstan, Kyrgyzstan, Tajikistan, Turkmenistan, Uzbekistan",
    "Europe": "Albania, Andorra, Armenia, Austria, Azerbaijan, Belarus, Belgium, Bosnia and Herzegovina, Bulgaria, Croatia, Cyprus, Czech Republic, Denmark, Estonia, Finland, France, Georgia, Germany, Greece, Hungary, Iceland, Ireland, Italy, Kosovo, Latvia, Liechtenstein, Lithuania, Luxembourg, Malta, Moldova, Monaco, Montenegro, Netherlands, North Macedonia, Norway, Poland, Portugal, Romania, Russian Federation, San Marino, Serbia, Slovakia, Slovenia, Spain, Sweden, Switzerland, Ukraine, United Kingdom",
    "Middle East": "Bahrain, Iran, Iraq, Israel, Jordan, Kuwait, Lebanon, Oman, Palestine, Qatar, Saudi Arabia, Syria, Turkey, United Arab Emirates, Yemen",
    "North America": "Canada, United States",
    "Latin America": "Antigua and Barbuda, Argentina, Bahamas, Barbados, Belize, Bolivia, Brazil, Chile, Colombia, Costa Rica, Cuba, Dominica, Dominican Republic, Ecuador, El Salvador, Grenada, Guatemala, Guyana, Haiti, Honduras, Jamaica, Mexico, Nicaragua, Panama, Paraguay, Peru, Puerto Rico, Saint Lucia, Suriname, Trinidad and Tobago, Uruguay, Venezuela",
    "Oceania": "Australia, Fiji, Kiribati, Marshall Islands, Micronesia, Nauru, New Zealand, Palau, Papua New Guinea, Samoa, Solomon Islands, Tonga, Tuvalu, Vanuatu",
}
# Other spellings of countries.
ALIASES = {
    "America": "United States",
    "Bosnia": "Bosnia and Herzegovina",
    "Burma": "Myanmar",
    "Cabo Verde": "Cape Verde",
    "Cote d'Ivoire": "Côte d’Ivoire",
    "Czechia": "Czech Republic",
    "Democratic Republic of the Congo": "DR Congo",
    "England": "United Kingdom",
    "Great Britain": "United Kingdom",
    "Holland": "Netherlands",
    "Ivory Coast": "Côte d’Ivoire",
    "Korea": "South Korea",
    "Kyrgyz Republic": "Kyrgyzstan",
    "Lao PDR": "Laos",
    "Macedonia": "North Macedonia",
    "Northern Ireland": "United Kingdom",
    "Palestinian Territories": "Palestine",
    "Republic of Ireland": "Ireland",
    "Republic of Korea": "South Korea",
    "Russia": "Russian Federation",
    "Scotland": "United Kingdom",
    "Slovak Republic": "Slovakia",
    "Swaziland": "Eswatini",
    "Syrian Arab Republic": "Syria",
    "The Netherlands": "Netherlands",
    "Timor Leste": "Timor-Leste",
    "Trinidad": "Trinidad and Tobago",
    "Türkiye": "Turkey",
    "U.A.E.": "United Arab Emirates",
    "U.K.": "United Kingdom",
    "U.S.": "United States",
    "U.S.A.": "United States",
    "UAE": "United Arab Emirates",
    "UK": "United Kingdom",
    "United States of America": "United States",
    "US": "United States",
    "USA": "United States",
    "Viet Nam": "Vietnam",
    "Wales": "United Kingdom",
}
# Names of regions and scopes that stand where a country should.
SCOPES = {
    "Africa": ["Africa", "East Africa", "North Africa", "Southern Africa", "Sub-Saharan Africa", "West Africa"],
    "South Asia": ["Asia", "South Asia"],
    "East Asia": ["East Asia"],
    "Southeast Asia": ["South East Asia", "South-East Asia", "Southeast Asia"],
    "Central Asia": ["Central Asia"],
    "Europe": ["Balkans", "Eastern Europe", "EU", "EU 27", "Europe", "European Union", "Western Europe"],
    "Middle East": ["MENA", "Middle East", "The Middle East"],
    "North America": ["North America", "Northern America"],
    "Latin America": ["Caribbean", "Central America", "Latin America", "Latin America and Caribbean", "South America", "The Caribbean"],
    "Oceania": ["Asia Pacific", "Asia-Pacific", "Oceania", "Pacific"],
    "Global": ["All countries", "Any country", "Developing countries", "Global", "Global South", "International", "Multiple countries", "Various", "Worldwide"],
}


def world(aliases: dict[str, str] | None = None) -> Places:
    """The places above, with further spellings."""
    by_country = {name: region for region, names in COUNTRIES.items() for name in names.split(", ")}
    spellings = {k.lower(): v for k, v in (ALIASES | (aliases or {})).items()}
    return Places({c.lower(): c for c in by_country} | spellings, {c.lower(): r for c, r in by_country.items()}, {s.lower(): r for r, names in SCOPES.items() for s in names})


WORLD = world()
