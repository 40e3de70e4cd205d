"""The class hierarchy as a dimension: sub-industries, each in one industry, each in one sector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A line for each industry, with its sector before it and its sub-industries after it.
CLASSES = """
ENERGY ENERGY_EQUIPMENT_AND_SERVICES OIL_AND_GAS_DRILLING OIL_AND_GAS_EQUIPMENT_AND_SERVICES
ENERGY OIL_GAS_AND_CONSUMABLE_FUELS INTEGRATED_OIL_AND_GAS OIL_AND_GAS_EXPLORATION_AND_PRODUCTION OIL_AND_GAS_REFINING_AND_MARKETING OIL_AND_GAS_STORAGE_AND_TRANSPORTATION COAL_AND_CONSUMABLE_FUELS
MATERIALS CHEMICALS COMMODITY_CHEMICALS DIVERSIFIED_CHEMICALS FERTILIZERS_AND_AGRICULTURAL_CHEMICALS INDUSTRIAL_GASES SPECIALTY_CHEMICALS
MATERIALS CONSTRUCTION_MATERIALS CONSTRUCTION_MATERIALS_SUB
MATERIALS CONTAINERS_AND_PACKAGING METAL_GLASS_AND_PLASTIC_CONTAINERS PAPER_AND_PLASTIC_PACKAGING_PRODUCTS_AND_MATERIALS
MATERIALS METALS_AND_MINING ALUMINUM DIVERSIFIED_METALS_AND_MINING COPPER GOLD PRECIOUS_METALS_AND_MINERALS SILVER STEEL
MATERIALS PAPER_AND_FOREST_PRODUCTS FOREST_PRODUCTS PAPER_PRODUCTS
INDUSTRIALS AEROSPACE_AND_DEFENSE AEROSPACE_AND_DEFENSE_SUB
INDUSTRIALS BUILDING_PRODUCTS BUILDING_PRODUCTS_SUB
INDUSTRIALS CONSTRUCTION_AND_ENGINEERING CONSTRUCTION_AND_ENGINEERING_SUB
INDUSTRIALS ELECTRICAL_EQUIPMENT ELECTRICAL_COMPONENTS_AND_EQUIPMENT HEAVY_ELECTRICAL_EQUIPMENT
INDUSTRIALS INDUSTRIAL_CONGLOMERATES INDUSTRIAL_CONGLOMERATES_SUB
INDUSTRIALS MACHINERY CONSTRUCTION_MACHINERY_AND_HEAVY_TRANSPORTATION_EQUIPMENT AGRICULTURAL_AND_FARM_MACHINERY INDUSTRIAL_MACHINERY_AND_SUPPLIES_AND_COMPONENTS
INDUSTRIALS TRADING_COMPANIES_AND_DISTRIBUTORS TRADING_COMPANIES_AND_DISTRIBUTORS_SUB
INDUSTRIALS COMMERCIAL_SERVICES_AND_SUPPLIES COMMERCIAL_PRINTING ENVIRONMENTAL_AND_FACILITIES_SERVICES OFFICE_SERVICES_AND_SUPPLIES DIVERSIFIED_SUPPORT_SERVICES SECURITY_AND_ALARM_SERVICES
INDUSTRIALS PROFESSIONAL_SERVICES HUMAN_RESOURCE_AND_EMPLOYMENT_SERVICES RESEARCH_AND_CONSULTING_SERVICES DATA_PROCESSING_AND_OUTSOURCED_SERVICES
INDUSTRIALS AIR_FREIGHT_AND_LOGISTICS AIR_FREIGHT_AND_LOGISTICS_SUB
INDUSTRIALS PASSENGER_AIRLINES PASSENGER_AIRLINES_SUB
INDUSTRIALS MARINE_TRANSPORTATION MARINE_TRANSPORTATION_SUB
INDUSTRIALS GROUND_TRANSPORTATION RAIL_TRANSPORTATION CARGO_GROUND_TRANSPORTATION PASSENGER_GROUND_TRANSPORTATION
INDUSTRIALS TRANSPORTATION_INFRASTRUCTURE AIRPORT_SERVICES HIGHWAYS_AND_RAILTRACKS MARINE_PORTS_AND_SERVICES
CONSUMER_DISCRETIONARY AUTOMOBILE_COMPONENTS AUTOMOTIVE_PARTS_AND_EQUIPMENT TIRES_AND_RUBBER
CONSUMER_DISCRETIONARY AUTOMOBILES AUTOMOBILE_MANUFACTURERS MOTORCYCLE_MANUFACTURERS
CONSUMER_DISCRETIONARY HOUSEHOLD_DURABLES CONSUMER_ELECTRONICS HOME_FURNISHINGS HOMEBUILDING HOUSEHOLD_APPLIANCES HOUSEWARES_AND_SPECIALTIES
CONSUMER_DISCRETIONARY LEISURE_PRODUCTS LEISURE_PRODUCTS_SUB
CONSUMER_DISCRETIONARY TEXTILES_APPAREL_AND_LUXURY_GOODS APPAREL_ACCESSORIES_AND_LUXURY_GOODS FOOTWEAR TEXTILES
CONSUMER_DISCRETIONARY HOTELS_RESTAURANTS_AND_LEISURE CASINOS_AND_GAMING HOTELS_RESORTS_AND_CRUISE_LINES LEISURE_FACILITIES RESTAURANTS
CONSUMER_DISCRETIONARY DIVERSIFIED_CONSUMER_SERVICES EDUCATION_SERVICES SPECIALIZED_CONSUMER_SERVICES
CONSUMER_DISCRETIONARY DISTRIBUTORS DISTRIBUTORS_SUB
CONSUMER_DISCRETIONARY BROADLINE_RETAIL BROADLINE_RETAIL_SUB
CONSUMER_DISCRETIONARY SPECIALTY_RETAIL APPAREL_RETAIL COMPUTER_AND_ELECTRONICS_RETAIL HOME_IMPROVEMENT_RETAIL OTHER_SPECIALTY_RETAIL AUTOMOTIVE_RETAIL HOMEFURNISHING_RETAIL
CONSUMER_STAPLES CONSUMER_STAPLES_DISTRIBUTION_AND_RETAIL DRUG_RETAIL FOOD_DISTRIBUTORS FOOD_RETAIL CONSUMER_STAPLES_MERCHANDISE_RETAIL
CONSUMER_STAPLES BEVERAGES BREWERS DISTILLERS_AND_VINTNERS SOFT_DRINKS_AND_NON_ALCOHOLIC_BEVERAGES
CONSUMER_STAPLES FOOD_PRODUCTS AGRICULTURAL_PRODUCTS_AND_SERVICES PACKAGED_FOODS_AND_MEATS
CONSUMER_STAPLES TOBACCO TOBACCO_SUB
CONSUMER_STAPLES HOUSEHOLD_PRODUCTS HOUSEHOLD_PRODUCTS_SUB
CONSUMER_STAPLES PERSONAL_CARE_PRODUCTS PERSONAL_CARE_PRODUCTS_SUB
HEALTH_CARE HEALTH_CARE_EQUIPMENT_AND_SUPPLIES HEALTH_CARE_EQUIPMENT HEALTH_CARE_SUPPLIES
HEALTH_CARE HEALTH_CARE_PROVIDERS_AND_SERVICES HEALTH_CARE_DISTRIBUTORS HEALTH_CARE_SERVICES HEALTH_CARE_FACILITIES MANAGED_HEALTH_CARE
HEALTH_CARE HEALTH_CARE_TECHNOLOGY HEALTH_CARE_TECHNOLOGY_SUB
HEALTH_CARE BIOTECHNOLOGY BIOTECHNOLOGY_SUB
HEALTH_CARE PHARMACEUTICALS PHARMACEUTICALS_SUB
HEALTH_CARE LIFE_SCIENCES_TOOLS_AND_SERVICES LIFE_SCIENCES_TOOLS_AND_SERVICES_SUB
FINANCIALS BANKS DIVERSIFIED_BANKS REGIONAL_BANKS
FINANCIALS FINANCIAL_SERVICES DIVERSIFIED_FINANCIAL_SERVICES MULTI_SECTOR_HOLDINGS SPECIALIZED_FINANCE COMMERCIAL_AND_RESIDENTIAL_MORTGAGE_FINANCE TRANSACTION_AND_PAYMENT_PROCESSING_SERVICES
FINANCIALS CONSUMER_FINANCE CONSUMER_FINANCE_SUB
FINANCIALS CAPITAL_MARKETS ASSET_MANAGEMENT_AND_CUSTODY_BANKS INVESTMENT_BANKING_AND_BROKERAGE DIVERSIFIED_CAPITAL_MARKETS FINANCIAL_EXCHANGES_AND_DATA
FINANCIALS MORTGAGE_REAL_ESTATE_INVESTMENT_TRUSTS MORTGAGE_REITS
FINANCIALS INSURANCE INSURANCE_BROKERS LIFE_AND_HEALTH_INSURANCE MULTI_LINE_INSURANCE PROPERTY_AND_CASUALTY_INSURANCE REINSURANCE
INFORMATION_TECHNOLOGY IT_SERVICES IT_CONSULTING_AND_OTHER_SERVICES INTERNET_SERVICES_AND_INFRASTRUCTURE
INFORMATION_TECHNOLOGY SOFTWARE APPLICATION_SOFTWARE SYSTEMS_SOFTWARE
INFORMATION_TECHNOLOGY COMMUNICATIONS_EQUIPMENT COMMUNICATIONS_EQUIPMENT_SUB
INFORMATION_TECHNOLOGY TECHNOLOGY_HARDWARE_STORAGE_AND_PERIPHERALS TECHNOLOGY_HARDWARE_STORAGE_AND_PERIPHERALS_SUB
INFORMATION_TECHNOLOGY ELECTRONIC_EQUIPMENT_INSTRUMENTS_AND_COMPONENTS ELECTRONIC_EQUIPMENT_AND_INSTRUMENTS ELECTRONIC_COMPONENTS ELECTRONIC_MANUFACTURING_SERVICES TECHNOLOGY_DISTRIBUTORS
INFORMATION_TECHNOLOGY SEMICONDUCTORS_AND_SEMICONDUCTOR_EQUIPMENT SEMICONDUCTOR_MATERIALS_AND_EQUIPMENT SEMICONDUCTORS
COMMUNICATION_SERVICES DIVERSIFIED_TELECOMMUNICATION_SERVICES ALTERNATIVE_CARRIERS INTEGRATED_TELECOMMUNICATION_SERVICES
COMMUNICATION_SERVICES WIRELESS_TELECOMMUNICATION_SERVICES WIRELESS_TELECOMMUNICATION_SERVICES_SUB
COMMUNICATION_SERVICES MEDIA ADVERTISING BROADCASTING CABLE_AND_SATELLITE PUBLISHING
COMMUNICATION_SERVICES ENTERTAINMENT MOVIES_AND_ENTERTAINMENT INTERACTIVE_HOME_ENTERTAINMENT
COMMUNICATION_SERVICES INTERACTIVE_MEDIA_AND_SERVICES INTERACTIVE_MEDIA_AND_SERVICES_SUB
UTILITIES ELECTRIC_UTILITIES ELECTRIC_UTILITIES_SUB
UTILITIES GAS_UTILITIES GAS_UTILITIES_SUB
UTILITIES MULTI_UTILITIES MULTI_UTILITIES_SUB
UTILITIES WATER_UTILITIES WATER_UTILITIES_SUB
UTILITIES INDEPENDENT_POWER_AND_RENEWABLE_ELECTRICITY_PRODUCERS INDEPENDENT_POWER_PRODUCERS_AND_ENERGY_TRADERS RENEWABLE_ELECTRICITY
REAL_ESTATE DIVERSIFIED_REITS DIVERSIFIED_REITS_SUB
REAL_ESTATE INDUSTRIAL_REITS INDUSTRIAL_REITS_SUB
REAL_ESTATE HOTEL_AND_RESORT_REITS HOTEL_AND_RESORT_REITS_SUB
REAL_ESTATE OFFICE_REITS OFFICE_REITS_SUB
REAL_ESTATE HEALTH_CARE_REITS HEALTH_CARE_REITS_SUB
REAL_ESTATE RESIDENTIAL_REITS MULTI_FAMILY_RESIDENTIAL_REITS SINGLE_FAMILY_RESIDENTIAL_REITS
REAL_ESTATE RETAIL_REITS RETAIL_REITS_SUB
REAL_ESTATE SPECIALIZED_REITS OTHER_SPECIALIZED_REITS SELF_STORAGE_REITS TELECOM_TOWER_REITS TIMBER_REITS DATA_CENTER_REITS
REAL_ESTATE REAL_ESTATE_MANAGEMENT_AND_DEVELOPMENT DIVERSIFIED_REAL_ESTATE_ACTIVITIES REAL_ESTATE_OPERATING_COMPANIES REAL_ESTATE_DEVELOPMENT REAL_ESTATE_SERVICES
"""
ROWS = [(sub, industry, sector) for line in CLASSES.split("\n") if line for sector, industry, *subs in [line.split()] for sub in subs]
SECTORS = tuple(dict.fromkeys(sector for _, _, sector in ROWS))


def dimension(spark: SparkSession) -> DataFrame:
    """(sub, industry, sector), 163 rows."""
    return spark.createDataFrame(ROWS, "sub string, industry string, sector string")


#: The same rows for DuckDB.
SQL = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{s}', '{i}', '{c}')" for k, (s, i, c) in enumerate(ROWS)) + ") AS d(n, sub, industry, sector))"
