"""Schemas of the raw sources and of the canonical record."""

CANONICAL = (
    "portal string, source_id string, source_url string, title string, company_name string, company_is_agency boolean, "
    "description_md string, description_truncated boolean, city string, postal_code string, canton string, lat double, lon double, "
    "workload_min int, workload_max int, is_permanent boolean, start_date date, home_office boolean, posted_at timestamp, expires_at timestamp, "
    "status string, apply_url string, occupation_codes array<string>, categories array<string>, languages array<string>, raw_path string"
)

# Nested search records: numbers and flags arrive as strings or booleans, so they are read as strings.
SOURCE_A = (
    "id string, createdTime string, updatedTime string, status string, externalReference string, "
    "jobContent struct<externalUrl:string,"
    "jobDescriptions:array<struct<languageIsoCode:string,title:string,description:string>>,"
    "company:struct<name:string,street:string,houseNumber:string,postalCode:string,city:string,countryIsoCode:string,website:string,surrogate:boolean>,"
    "employment:struct<startDate:string,endDate:string,shortEmployment:boolean,immediately:boolean,permanent:boolean,workloadPercentageMin:string,workloadPercentageMax:string,workForms:array<string>>,"
    "location:struct<city:string,postalCode:string,communalCode:string,regionCode:string,cantonCode:string,countryIsoCode:string,coordinates:struct<lon:string,lat:string>>,"
    "occupations:array<struct<avamOccupationCode:string,workExperience:string,educationCode:string,qualificationCode:string>>,"
    "languageSkills:array<struct<languageIsoCode:string,spokenLevel:string,writtenLevel:string>>,"
    "applyChannelFlags:struct<apply_via_email:boolean,apply_via_phone:boolean,apply_via_post:boolean,form_url:string>>, "
    "publication struct<startDate:string,endDate:string,publicDisplay:boolean,companyAnonymous:boolean>"
)

SOURCE_B = (
    "id bigint, title string, company_id bigint, workplace_zip string, workplace_city string, activity string, requirements string, offer string, "
    "url_application string, url_description string, type_key int, type_value_min int, type_value_max int, date_actualization string, "
    "date_start string, date_first_published string, is_special_offer boolean, is_promoted boolean, is_shown_on_company_minisite boolean, "
    "home_office boolean, positions array<string>, external_id string, country_code array<string>, keywords string, video_url string, "
    "company_description string, company struct<id:bigint,name:string,description:string,homepage:string,zip:string,city:string,street:string,house_number:string>, "
    "categories array<struct<id:bigint,title:string,description:string,order_position:int,is_active:boolean,platform_id:array<int>>>, "
    "has_contact_person boolean, _source_url string"
)

TAXONOMY = (
    "job_id string, title string, description string, "
    "categories struct<berufsfelder:array<string>,branchen:array<string>,swissdoc:string,bildungstypen:array<string>>, "
    "taetigkeiten struct<kategorien:map<string,array<string>>>, "
    "weiterbildung struct<career_progression:array<struct<level:string,type:string,options:array<string>>>>, "
    "weitere_informationen struct<verwandte_berufe:array<struct<title:string,job_id:string>>>"
)
