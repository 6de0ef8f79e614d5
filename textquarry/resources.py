"""Word lists, lookup tables and patterns whose values fix results; all are fixed values, in the order in which they are used."""

from __future__ import annotations

# Act names as they occur in texts and queries, in the order in which they are tried, and their codes.
ACT_CODES = {'ipc': 'IPC',
 'indian penal code': 'IPC',
 'bns': 'BNS',
 'bharatiya nyaya sanhita': 'BNS',
 'crpc': 'CRPC',
 'code of criminal procedure': 'CRPC',
 'bnss': 'BNSS',
 'bharatiya nagarik suraksha sanhita': 'BNSS',
 'bsa': 'BSA',
 'bharatiya sakshya adhiniyam': 'BSA',
 'evidence act': 'BSA',
 'indian evidence act': 'BSA',
 'cpc': 'CPC'}

# Words that mark a legal query.
LEGAL_INTENT_WORDS = ('section', 'ipc', 'bns', 'crpc', 'bnss', 'bsa', 'cpc', 'act', 'court', 'judge', 'justice', 'law', 'legal', 'statute', 'code', 'murder', 'theft',
 'assault', 'rape', 'fraud', 'forgery', 'cheating', 'bail', 'arrest', 'custody', 'fir', 'charge', 'accused', 'conviction', 'acquittal', 'sentence',
 'punishment', 'imprisonment', 'fine', 'plaintiff', 'defendant', 'petition', 'writ', 'appeal', 'judgment', 'dowry', 'cruelty', 'divorce',
 'maintenance', 'alimony', 'adoption', 'guardian', 'succession', 'inheritance', 'will', 'probate', 'contract', 'agreement', 'consideration', 'void',
 'voidable', 'negligence', 'liability', 'damages', 'compensation', 'injunction', 'mortgage', 'lease', 'rent', 'eviction', 'trespass', 'partition',
 'consumer', 'wages', 'employer', 'employee', 'termination', 'industrial', 'labour', 'labor', 'drunk', 'driving', 'narcotic', 'ndps', 'cyber',
 'digital', 'electronic', 'evidence', 'witness', 'confession', 'admissible', 'admissibility', 'interrogation', 'right to', 'fundamental right',
 'article', 'constitutional', 'high court', 'supreme court', 'tribunal', 'crime', 'offence', 'offense', 'criminal', 'cognizable', 'bailable',
 'remedy', 'relief', 'claim', 'dispute', 'case', 'suit', 'stole', 'steal', 'stealing', 'stolen', 'robbed', 'robbery', 'rob', 'killed', 'killing',
 'kill', 'stabbed', 'stab', 'hit', 'struck', 'damaged', 'vandalized', 'broke', 'broken', 'snatched', 'snatch', 'picked', 'pocket', 'burglary',
 'break-in', 'trespassing', 'dupe', 'scam', 'defraud', 'blackmail', 'extortion', 'bribery', 'bike', 'vehicle', 'car', 'motorcycle', 'scooter',
 'property', 'silencer', 'battery', 'wheel', 'part', 'component', 'file', 'complaint', 'police', 'station', 'ipc section', 'bns section',
 'punishable', 'imprisonment', 'jail', 'prison')

# Query words that are no concepts.
CONCEPT_STOP_WORDS = ('and', 'are', 'bns', 'bnss', 'compare', 'comparison', 'crpc', 'difference', 'explain', 'for', 'ipc', 'legal', 'of', 'punishable', 'punished',
 'punishment', 'section', 'the', 'under', 'what')

# Act names and the names they have in the corpus.
ACT_FULL_NAMES = {'ipc': ['Indian Penal Code, 1860'],
 'indian penal code': ['Indian Penal Code, 1860'],
 'bns': ['Bharatiya Nyaya Sanhita, 2023'],
 'bharatiya nyaya sanhita': ['Bharatiya Nyaya Sanhita, 2023'],
 'crpc': ['Code of Criminal Procedure, 1973'],
 'code of criminal procedure': ['Code of Criminal Procedure, 1973'],
 'bnss': ['Bharatiya Nagarik Suraksha Sanhita, 2023'],
 'bharatiya nagarik suraksha sanhita': ['Bharatiya Nagarik Suraksha Sanhita, 2023'],
 'bsa': ['Bharatiya Sakshya Adhiniyam, 2023', 'erstwhile Indian Evidence Act, 1872', 'Indian Evidence Act, 1872'],
 'bharatiya sakshya adhiniyam': ['Bharatiya Sakshya Adhiniyam, 2023'],
 'evidence act': ['Bharatiya Sakshya Adhiniyam, 2023', 'erstwhile Indian Evidence Act, 1872', 'Indian Evidence Act, 1872'],
 'indian evidence act': ['erstwhile Indian Evidence Act, 1872', 'Indian Evidence Act, 1872'],
 'cpc': ['Code of Civil Procedure, 1908'],
 'code of civil procedure': ['Code of Civil Procedure, 1908'],
 'transfer of property': ['Transfer of Property Act, 1882'],
 'transfer of property act': ['Transfer of Property Act, 1882'],
 'indian contract act': ['Indian Contract Act, 1872'],
 'consumer protection': ['Consumer Protection Act, 2019'],
 'consumer protection act': ['Consumer Protection Act, 2019'],
 'ndps': ['Narcotic Drugs and Psychotropic Substances Act, 1985'],
 'ndps act': ['Narcotic Drugs and Psychotropic Substances Act, 1985'],
 'motor vehicles': ['Motor Vehicles Act, 1988'],
 'motor vehicles act': ['Motor Vehicles Act, 1988'],
 'hindu succession': ['Hindu Succession Act, 1956'],
 'hindu succession act': ['Hindu Succession Act, 1956'],
 'hindu marriage': ['Hindu Marriage Act, 1955'],
 'hindu marriage act': ['Hindu Marriage Act, 1955'],
 'constitution': ['Constitution of India'],
 'constitution of india': ['Constitution of India'],
 'limitation': ['Limitation Act, 1963'],
 'limitation act': ['Limitation Act, 1963'],
 'arbitration': ['Arbitration and Conciliation Act, 1996'],
 'arbitration act': ['Arbitration and Conciliation Act, 1996'],
 'negotiable instruments': ['Negotiable Instruments Act, 1881'],
 'ni act': ['Negotiable Instruments Act, 1881']}

# Routing: legal words.
ROUTE_LEGAL_WORDS = ('ipc', 'bns', 'crpc', 'bnss', 'evidence act', 'bharatiya nyaya sanhita', 'bharatiya nagarik suraksha sanhita', 'bharatiya sakshya', 'section', 'fir',
 'bail', 'offence', 'offense', 'petition', 'writ', 'appeal', 'judgment', 'judgement', 'high court', 'supreme court', 'statute', 'bare act',
 'punishment', 'theft', 'murder', 'assault', 'liability', 'legal', 'statutory', 'provision', 'constitution', 'article', 'dowry', 'cruelty',
 'consumer protection', 'ndps', 'narcotic', 'motor vehicles', 'industrial disputes', 'factories act', 'hindu succession', 'hindu marriage',
 'transfer of property', 'indian contract', 'limitation act', 'code of criminal', 'code of civil')

# Routing: legal topics.
ROUTE_TOPIC_WORDS = ('confession', 'admissible', 'admissibility', 'evidence', 'witness', 'accused', 'interrogation', 'arrest', 'detention', 'custody', 'bail', 'minor',
 'contract', 'void', 'voidable', 'capacity', 'inheritance', 'succession', 'will', 'probate', 'divorce', 'maintenance', 'alimony', 'cruelty', 'dowry',
 'rape', 'murder', 'culpable homicide', 'theft', 'robbery', 'cheating', 'fraud', 'forgery', 'forged', 'defamation', 'trespass', 'negligence',
 'malpractice', 'wages', 'employer', 'employee', 'termination', 'retrenchment', 'drunk driving', 'dui', 'driving under influence', 'insurance',
 'claim', 'compensation', 'damages', 'injunction', 'specific performance', 'mortgage', 'lease', 'rent', 'eviction', 'partition', 'guardian',
 'custody of child', 'adoption', 'maintenance of parents', 'charity', 'trust', 'tax', 'gst', 'income tax', 'penalty', 'fine', 'imprisonment',
 'rigorous imprisonment', 'simple imprisonment', 'death penalty', 'life imprisonment', 'charged with', 'charged of', 'crime', 'offence', 'offense',
 'criminal', 'punishable', 'liable', 'guilty', 'innocent', 'acquittal', 'conviction', 'sentence', 'bailable', 'non-bailable', 'cognizable',
 'cognisable', 'fir filed', 'police complaint', 'legal remedy', 'legal option', 'what is the punishment', 'what is the law', 'is it legal',
 'is it a crime', 'can i file', 'how to file', 'time limit', 'limitation period', 'right to', 'fundamental right')

# Routing: civil law.
ROUTE_CIVIL_WORDS = ('cpc', 'civil procedure', 'code of civil procedure', 'civil court', 'district court', 'civil suit', 'plaint', 'written statement', 'decree',
 'execution', 'limitation', 'limitation act', 'civil appeal', 'civil revision', 'rent act', 'tenancy', 'eviction', 'partition', 'succession', 'heir',
 'inheritance', 'will', 'probate', 'contract act', 'agreement', 'breach of contract', 'specific performance', 'hindu marriage', 'hindu succession',
 'divorce', 'maintenance', 'alimony', 'transfer of property', 'sale deed', 'gift deed', 'mortgage', 'lease', 'injunction', 'compensation', 'damages',
 'recovery', 'order 1 cpc', 'order 6 cpc', 'order 9 cpc', 'order 21 cpc', 'order 32 cpc', 'order 39 cpc')

# Routing: strategy.
ROUTE_STRATEGY_WORDS = ('strategy', 'strategic', "what's the move", 'what is the move', 'next move', 'next step', 'best move', 'best approach', 'tactic', 'plan',
 'positioning', 'negotiate', 'settle', 'defend', 'attack', 'argue', 'how should i respond')

# Routing: documents.
ROUTE_DOCUMENT_WORDS = ('document', 'pdf', 'ocr', 'scan', 'file', 'upload', 'attachment', 'evidence', 'annexure', 'contract', 'notice', 'analyze this', 'analyse this',
 'review this file')

# Entity parser: acts.
KNOWN_ACTS = {'indian penal code': 'Indian Penal Code',
 'ipc': 'Indian Penal Code',
 'bharatiya nyaya sanhita': 'Bharatiya Nyaya Sanhita',
 'bns': 'Bharatiya Nyaya Sanhita',
 'code of criminal procedure': 'Code of Criminal Procedure',
 'crpc': 'Code of Criminal Procedure',
 'bharatiya nagarik suraksha sanhita': 'Bharatiya Nagarik Suraksha Sanhita',
 'bnss': 'Bharatiya Nagarik Suraksha Sanhita',
 'indian evidence act': 'Indian Evidence Act',
 'evidence act': 'Indian Evidence Act',
 'bharatiya sakshya adhiniyam': 'Bharatiya Sakshya Adhiniyam',
 'bharatiya sakshya': 'Bharatiya Sakshya Adhiniyam',
 'code of civil procedure': 'Code of Civil Procedure',
 'cpc': 'Code of Civil Procedure',
 'transfer of property act': 'Transfer of Property Act',
 'indian contract act': 'Indian Contract Act',
 'contract act': 'Indian Contract Act',
 'specific relief act': 'Specific Relief Act',
 'limitation act': 'Limitation Act',
 'indian succession act': 'Indian Succession Act',
 'hindu succession act': 'Hindu Succession Act',
 'hindu marriage act': 'Hindu Marriage Act',
 'special marriage act': 'Special Marriage Act',
 'hindu minority and guardianship act': 'Hindu Minority and Guardianship Act',
 'muslim women protection of rights on divorce act': 'Muslim Women Protection Act',
 'constitution of india': 'Constitution of India',
 'constitution': 'Constitution of India',
 'consumer protection act': 'Consumer Protection Act',
 'narcotic drugs and psychotropic substances act': 'NDPS Act',
 'ndps act': 'NDPS Act',
 'ndps': 'NDPS Act',
 'motor vehicles act': 'Motor Vehicles Act',
 'industrial disputes act': 'Industrial Disputes Act',
 'industrial disputes': 'Industrial Disputes Act',
 'factories act': 'Factories Act',
 'minimum wages act': 'Minimum Wages Act',
 'payment of wages act': 'Payment of Wages Act',
 'employees provident fund act': 'Employees Provident Fund Act',
 'information technology act': 'Information Technology Act',
 'it act': 'Information Technology Act',
 'prevention of corruption act': 'Prevention of Corruption Act',
 'dowry prohibition act': 'Dowry Prohibition Act',
 'dowry': 'Dowry Prohibition Act',
 'protection of women from domestic violence act': 'Domestic Violence Act',
 'domestic violence act': 'Domestic Violence Act',
 'juvenile justice act': 'Juvenile Justice Act',
 'negotiable instruments act': 'Negotiable Instruments Act',
 'arbitration and conciliation act': 'Arbitration Act',
 'trade marks act': 'Trade Marks Act',
 'patents act': 'Patents Act',
 'environment protection act': 'Environment Protection Act',
 'forest act': 'Forest Act',
 'wildlife protection act': 'Wildlife Protection Act',
 'arms act': 'Arms Act',
 'guardians and wards act': 'Guardians and Wards Act',
 'indian divorce act': 'Indian Divorce Act',
 'maintenance and welfare of parents and senior citizens act': 'Maintenance Act',
 'competition act': 'Competition Act',
 'companies act': 'Companies Act',
 'limited liability partnership act': 'LLP Act',
 'indian partnership act': 'Indian Partnership Act',
 'sale of goods act': 'Sale of Goods Act',
 'indian registration act': 'Indian Registration Act',
 'indian stamps act': 'Indian Stamps Act',
 'easements act': 'Easements Act',
 'indian trusts act': 'Indian Trusts Act',
 'trusts act': 'Indian Trusts Act',
 'right to information act': 'Right to Information Act',
 'rti act': 'Right to Information Act',
 'legal services authorities act': 'Legal Services Authorities Act',
 'family courts act': 'Family Courts Act',
 'gram nyayalayas act': 'Gram Nyayalayas Act',
 'copyright act': 'Copyright Act',
 'designs act': 'Designs Act',
 'geographical indications act': 'Geographical Indications Act',
 'semiconductor act': 'Semiconductor Act',
 'biological diversity act': 'Biological Diversity Act',
 'plant varieties act': 'Plant Varieties Act',
 'indian telegraph act': 'Indian Telegraph Act',
 'indian wireless act': 'Indian Wireless Act',
 'cinematograph act': 'Cinematograph Act',
 'central goods and services tax act': 'CGST Act',
 'state goods and services tax act': 'SGST Act',
 'integrated goods and services tax act': 'IGST Act',
 'customs act': 'Customs Act',
 'finance act': 'Finance Act',
 'benami transactions prohibition act': 'Benami Act',
 'black money act': 'Black Money Act',
 'insolvency and bankruptcy code': 'IBC',
 'insolvency and bankruptcy code act': 'IBC',
 'real estate regulation and development act': 'RERA',
 'securities and exchange board of india act': 'SEBI Act',
 'national rural employment guarantee act': 'NREGA',
 'probation of offenders act': 'Probation Act',
 'national security act': 'NSA',
 'unlawful activities prevention act': 'UAPA',
 'maharashtra control of organised crime act': 'MCOCA',
 'prevention of money laundering act': 'PMLA',
 'narcoics control bureau act': 'NCB Act',
 'commissions for protection of child rights act': 'Child Rights Act',
 'protection of children from sexual offences act': 'POCSO',
 'posco act': 'POCSO',
 'food safety and standards act': 'Food Safety Act',
 'inter-state water disputes act': 'Inter-State Water Disputes Act',
 'indian penal code 1860': 'Indian Penal Code',
 'bharatiya nyaya sanhita 2023': 'Bharatiya Nyaya Sanhita',
 'indian evidence act 1872': 'Indian Evidence Act'}

# Entity parser: topics.
KNOWN_TOPICS = {'bail': 'bail',
 'anticipatory bail': 'anticipatory_bail',
 'regular bail': 'regular_bail',
 'default bail': 'default_bail',
 'anticipbail': 'anticipatory_bail',
 'arrest': 'arrest',
 'fir': 'fir',
 'first information report': 'fir',
 'charge sheet': 'charge_sheet',
 'chargesheet': 'charge_sheet',
 'trial': 'trial',
 'appeal': 'appeal',
 'revision': 'revision',
 'writ': 'writ',
 'injunction': 'injunction',
 'divorce': 'divorce',
 'maintenance': 'maintenance',
 'alimony': 'alimony',
 'custody': 'custody',
 'guardianship': 'guardianship',
 'adoption': 'adoption',
 'succession': 'succession',
 'inheritance': 'inheritance',
 'will': 'will',
 'probate': 'probate',
 'partition': 'partition',
 'mortgage': 'mortgage',
 'lease': 'lease',
 'rent': 'rent',
 'eviction': 'eviction',
 'specific performance': 'specific_performance',
 'breach of contract': 'breach_of_contract',
 'damages': 'damages',
 'compensation': 'compensation',
 'recovery': 'recovery',
 'execution': 'execution',
 'decree': 'decree',
 'judgment': 'judgment',
 'order': 'order',
 'sentence': 'sentence',
 'punishment': 'punishment',
 'penalty': 'penalty',
 'fine': 'fine',
 'imprisonment': 'imprisonment',
 'death penalty': 'death_penalty',
 'life imprisonment': 'life_imprisonment',
 'parole': 'parole',
 'remission': 'remission',
 'pardon': 'pardon',
 'forgery': 'forgery',
 'fraud': 'fraud',
 'cheating': 'cheating',
 'defamation': 'defamation',
 'criminal intimidation': 'criminal_intimidation',
 'extortion': 'extortion',
 'robbery': 'robbery',
 'dacoity': 'dacoity',
 'kidnapping': 'kidnapping',
 'abduction': 'abduction',
 'rape': 'rape',
 'sexual assault': 'sexual_assault',
 'molestation': 'molestation',
 'harassment': 'harassment',
 'stalking': 'stalking',
 'dowry death': 'dowry_death',
 'cruelty': 'cruelty',
 'murder': 'murder',
 'culpable homicide': 'culpable_homicide',
 'accident': 'accident',
 'drunk driving': 'drunk_driving',
 'hit and run': 'hit_and_run',
 'theft': 'theft',
 'shoplifting': 'shoplifting',
 'burglary': 'burglary',
 'house breaking': 'house_breaking',
 'criminal breach of trust': 'criminal_breach_of_trust',
 'misappropriation': 'misappropriation',
 'criminal trespass': 'criminal_trespass',
 'nuisance': 'nuisance',
 'trespass': 'trespass'}

# Entity parser: courts.
KNOWN_COURTS = {'supreme court': 'Supreme Court of India',
 'high court': 'High Court',
 'district court': 'District Court',
 'sessions court': 'Sessions Court',
 'metropolitan magistrate': 'Metropolitan Magistrate',
 'judicial magistrate': 'Judicial Magistrate',
 'executive magistrate': 'Executive Magistrate',
 'family court': 'Family Court',
 'consumer forum': 'Consumer Forum',
 'national green tribunal': 'National Green Tribunal',
 'nclt': 'NCLT',
 'nclat': 'NCLAT',
 'itat': 'ITAT',
 'arbital tribunal': 'Arbital Tribunal',
 'labour court': 'Labour Court',
 'industrial tribunal': 'Industrial Tribunal',
 'debt recovery tribunal': 'Debt Recovery Tribunal'}

# Query analysis: act names.
QUERY_ACT_NAMES = {'ipc': 'Indian Penal Code, 1860',
 'indian penal code': 'Indian Penal Code, 1860',
 'bns': 'Bharatiya Nyaya Sanhita, 2023',
 'bharatiya nyaya sanhita': 'Bharatiya Nyaya Sanhita, 2023',
 'crpc': 'Code of Criminal Procedure, 1973',
 'code of criminal procedure': 'Code of Criminal Procedure, 1973',
 'bnss': 'Bharatiya Nagarik Suraksha Sanhita, 2023',
 'bharatiya nagarik suraksha sanhita': 'Bharatiya Nagarik Suraksha Sanhita, 2023',
 'bsa': 'Bharatiya Sakshya Adhiniyam, 2023',
 'bharatiya sakshya adhiniyam': 'Bharatiya Sakshya Adhiniyam, 2023',
 'iea': 'Indian Evidence Act, 1872',
 'indian evidence act': 'Indian Evidence Act, 1872',
 'evidence act': 'Indian Evidence Act, 1872',
 'cpc': 'Code of Civil Procedure, 1908',
 'code of civil procedure': 'Code of Civil Procedure, 1908'}

# Query analysis: short act names.
SHORT_ACT_NAMES = {'ipc': 'IPC', 'bns': 'BNS', 'crpc': 'CrPC', 'bnss': 'BNSS', 'bsa': 'BSA', 'iea': 'IEA', 'cpc': 'CPC'}

# Query analysis: pattern, concepts, acts, sections.
QUERY_CONCEPTS = [('in.?laws?.*demand|dowry.*demand|demanding.*money.*marriage|bride.*burn', ['dowry', 'cruelty', '498A', 'maintenance'],
  ['Indian Penal Code, 1860', 'Bharatiya Nyaya Sanhita, 2023'], ['498A']),
 ('domestic\\s+violence|husband.*beat|wife.*abuse', ['domestic violence', 'cruelty', '498A'],
  ['Indian Penal Code, 1860', 'Protection of Women from Domestic Violence Act, 2005'], ['498A']),
 ('employer.*not\\s+pay|wages.*unpaid|salary.*pending|unpaid\\s+wages', ['wages', 'employer', 'industrial dispute', 'labour court'],
  ['Industrial Disputes Act, 1947'], []),
 ('minor.*contract|child.*agreement|under\\s+18.*contract', ['minor', 'contract', 'void', 'Section 10'], ['Indian Contract Act, 1872'], ['10']),
 ('drunk\\s+driv|drink.*drive|alcohol.*driv|dwi|dui', ['drunk driving', 'Motor Vehicles Act', 'Section 185', 'penalty'], ['Motor Vehicles Act, 1988'],
  ['185']),
 ('inheritance.*will|intestate|die.*without\\s+will|succession.*hindu', ['intestate', 'Hindu Succession Act', 'heir', 'coparcenary'],
  ['Hindu Succession Act, 1956'], []),
 ('accused.*right|right.*accused|police.*interrogat|arrested.*right|right.*interrogat',
  ['accused', 'rights', 'police', 'legal counsel', 'advocate', 'Section 41D', 'BNSS'],
  ['Code of Criminal Procedure, 1973', 'Bharatiya Nagarik Suraksha Sanhita, 2023'], ['41D']),
 ('confession.*police|police.*confession|admissib.*confession', ['confession', 'police', 'admissible', 'Section 25', 'evidence'],
  ['Indian Evidence Act, 1872', 'Bharatiya Sakshya Adhiniyam, 2023'], ['25']),
 ('limitation.*suit|time\\s+limit.*(sue|suit)|filing.*deadline|limitation\\s+period|time\\s+limit.*file',
  ['limitation', 'time limit', '3 years', 'Limitation Act'], ['Limitation Act, 1963'], []),
 ('false.*case|wrongful.*charge|framed.*crime|falsely.*accused|charged.*crime.*didn|didn.*commit',
  ['false', 'wrongful', 'acquittal', 'innocent', 'malicious prosecution', 'wrongful prosecution'],
  ['Indian Penal Code, 1860', 'Bharatiya Nyaya Sanhita, 2023', 'Code of Criminal Procedure, 1973'], ['211']),
 ('forged.*sign|signature.*forg|forgery.*document', ['forgery', 'fraud', 'signature', 'crime'],
  ['Indian Penal Code, 1860', 'Bharatiya Nyaya Sanhita, 2023'], ['463', '471']),
 ('bail.*provisions?|anticipatory.*bail|bail.*application|grant.*bail|default.*bail',
  ['bail', 'anticipatory bail', 'default bail', 'Section 480', 'BNSS'],
  ['Code of Criminal Procedure, 1973', 'Bharatiya Nagarik Suraksha Sanhita, 2023'], ['437', '438', '480']),
 ('consumer.*rights?|defective.*goods|deficiency.*service|unfair.*trade.*practice',
  ['consumer rights', 'defective goods', 'deficiency services', 'unfair trade', 'Section 38', 'Consumer Protection Act'],
  ['Consumer Protection Act, 2019'], ['38'])]

# Query analysis: patterns of acts.
QUERY_ACT_PATTERNS = [('\\bipc\\b|\\bindian penal code\\b', 'Indian Penal Code, 1860'), ('\\bbns\\b|\\bbharatiya nyaya sanhita\\b', 'Bharatiya Nyaya Sanhita, 2023'),
 ('\\bcrpc\\b|\\bcode of criminal procedure\\b', 'Code of Criminal Procedure, 1973'),
 ('\\bbnss\\b|\\bbharatiya nagarik suraksha sanhita\\b', 'Bharatiya Nagarik Suraksha Sanhita, 2023'),
 ('\\bbsa\\b|\\bbharatiya sakshya adhiniyam\\b', 'Bharatiya Sakshya Adhiniyam, 2023'),
 ('\\biea\\b|\\bindian evidence act\\b|\\bevidence act\\b', 'Indian Evidence Act, 1872'),
 ('\\bcpc\\b|\\bcode of civil procedure\\b', 'Code of Civil Procedure, 1908'), ('\\bconsumer protection\\b', 'Consumer Protection Act, 2019'),
 ('\\bndps\\b|\\bnarcotic drugs\\b', 'Narcotic Drugs and Psychotropic Substances Act, 1985'),
 ('\\btransfer of property\\b', 'Transfer of Property Act, 1882'), ('\\bconstitution\\b', 'Constitution of India'),
 ('\\bindian contract act\\b', 'Indian Contract Act, 1872'), ('\\bhindu marriage\\b', 'Hindu Marriage Act, 1955'),
 ('\\bhindu succession\\b', 'Hindu Succession Act, 1956'), ('\\bmotor vehicles\\b', 'Motor Vehicles Act, 1988'),
 ('\\bindustrial disputes\\b', 'Industrial Disputes Act, 1947'), ('\\blimitation act\\b', 'Limitation Act, 1963'),
 ('\\bnegotiable instruments\\b|\\bni act\\b', 'Negotiable Instruments Act, 1881'), ('\\barbitration\\b', 'Arbitration and Conciliation Act, 1996'),
 ('\\bcopyright act\\b', 'Copyright Act, 1957'), ('\\bcompetition act\\b', 'Competition Act, 2002')]

# Query analysis: words of comparisons between acts.
CROSS_ACT_WORDS = ['equivalent', 'counterpart', 'replaced by', 'corresponding', 'new section', 'old section', 'was section', 'now section', 'bns equivalent',
 'ipc equivalent', 'mapped to', 'corresponds to', 'compare', 'comparison', 'difference between', 'vs', 'versus']

# Entity reranking: words of acts.
RERANK_ACT_WORDS = {'Indian Penal Code': ['ipc', 'indian penal code', 'penal code'],
 'Bharatiya Nyaya Sanhita': ['bns', 'bharatiya nyaya'],
 'Code of Criminal Procedure': ['crpc', 'code of criminal', 'criminal procedure'],
 'Bharatiya Nagarik Suraksha Sanhita': ['bnss', 'bharatiya nagarik'],
 'Indian Evidence Act': ['evidence act', 'indian evidence'],
 'Bharatiya Sakshya Adhiniyam': ['bharatiya sakshya', 'sakshya adhiniyam'],
 'Code of Civil Procedure': ['cpc', 'code of civil', 'civil procedure'],
 'Transfer of Property Act': ['transfer of property'],
 'Indian Contract Act': ['contract act', 'indian contract'],
 'Consumer Protection Act': ['consumer protection'],
 'NDPS Act': ['ndps', 'narcotic drugs'],
 'Motor Vehicles Act': ['motor vehicles'],
 'Hindu Succession Act': ['hindu succession'],
 'Hindu Marriage Act': ['hindu marriage'],
 'Constitution of India': ['constitution', 'constitutional']}

# Entity reranking: words of topics.
RERANK_TOPIC_WORDS = {'bail': ['bail', 'anticipatory bail', 'default bail'],
 'anticipatory_bail': ['anticipatory bail', 'pre-arrest bail', 'section 438'],
 'murder': ['murder', 'culpable homicide', 'section 302'],
 'theft': ['theft', 'larceny', 'section 378'],
 'rape': ['rape', 'sexual assault', 'section 376'],
 'dowry': ['dowry', 'cruelty', 'section 498a'],
 'fraud': ['fraud', 'cheating', 'forgery'],
 'divorce': ['divorce', 'dissolution', 'section 13'],
 'fir': ['fir', 'first information report', 'section 154']}

# Structure parser: act aliases in order.
STRUCTURE_ACT_CODES = {'bharatiya nyaya sanhita': 'BNS',
 'bharatiya nagarik suraksha sanhita': 'BNSS',
 'bharatiya sakshya adhiniyam': 'BSA',
 'indian penal code': 'IPC',
 'code of criminal procedure': 'CRPC',
 'indian evidence act': 'IEA',
 'code of civil procedure': 'CPC',
 'constitution of india': 'Constitution'}

# Structure parser: full act names.
STRUCTURE_ACT_NAMES = {'bharatiya nyaya sanhita': 'BNS',
 'bharatiya nyaya sanhita, 2023': 'BNS',
 'bharatiya nagarik suraksha sanhita': 'BNSS',
 'bharatiya nagarik suraksha sanhita, 2023': 'BNSS',
 'bharatiya sakshya adhiniyam': 'BSA',
 'bharatiya sakshya adhiniyam, 2023': 'BSA',
 'indian penal code': 'IPC',
 'indian penal code, 1860': 'IPC',
 'code of criminal procedure': 'CRPC',
 'code of criminal procedure, 1973': 'CRPC',
 'indian evidence act': 'IEA',
 'indian evidence act, 1872': 'IEA',
 'code of civil procedure': 'CPC',
 'code of civil procedure, 1908': 'CPC',
 'constitution of india': 'Constitution',
 'constitution of india, 1950': 'Constitution'}

# File names of commentaries.
COMMENTARY_WORDS = ['commentary', 'textbook', 'ratanlal', 'monir', 'durga das', 'mulla', 'pollock', 'merchant of madras', 'sarkar', 'viraranjan', 'bars', 'halsbury',
 'jolly', 'advanced', 'law Lexicon', 'wharton', 'z-library', '1lib.sk', 'z-lib.sk', 'fighting corruption']

# Spoken commands in order.
VOICE_COMMANDS = {'search': ['search', 'find', 'look up', 'query', 'research'],
 'compare': ['compare', 'versus', 'vs', 'difference between'],
 'cite': ['citation', 'cite', 'reference', 'source'],
 'bail': ['bail', 'anticipatory bail', 'regular bail'],
 'section': ['section', 'section under', ' IPC', ' BNS'],
 'help': ['help', 'commands', 'what can you do'],
 'exit': ['exit', 'quit', 'stop', 'close']}

# Speech corrections.
VOICE_CORRECTIONS = {'ipc': 'IPC',
 'bns': 'BNS',
 'crpc': 'CRPC',
 'bnss': 'BNSS',
 'bsa': 'BSA',
 'section': 'Section',
 'article': 'Article',
 'act': 'Act',
 'fir': 'FIR',
 'f i r': 'FIR'}

# Speech expansions.
VOICE_EXPANSIONS = {'murder': 'murder (Section 302 BNS)',
 'theft': 'theft (Section 318 BNS)',
 'robbery': 'robbery (Section 309 BNS)',
 'bail': 'bail under Section 437 CrPC',
 'cognizable': 'cognizable offence',
 'non cognizable': 'non-cognizable offence',
 'compoundable': 'compoundable offence',
 'bailable': 'bailable offence',
 'non bailable': 'non-bailable offence'}

# Court codes of reported cases.
VALID_COURT_CODES = ('AP', 'All', 'Bom', 'Cal', 'Chhatisgarh', 'Del', 'Gauhati', 'Guj', 'Gwalior', 'HP', 'Imphal', 'Indore', 'J&K', 'Jharkhand', 'KER', 'Karn', 'Lucknow',
 'MP', 'Mad', 'Manipur', 'Meghalaya', 'NB', 'Nagpur', 'Orissa', 'P&H', 'Panaji', 'Pat', 'Raj', 'SC', 'Shimla', 'Sikkim', 'Tripura', 'Uttarakhand')

# Answers when nothing is found.
REFUSALS = ['I cannot find this information in the loaded legal texts. The retrieved documents do not contain details about: {topic}',
 'The current knowledge base does not contain sufficient information to answer: {topic}. Please provide additional legal texts or clarify your '
 'query.',
 'No authoritative source found in the indexed corpus for: {topic}. This may require additional legal commentary or bare acts.',
 'The retrieved documents do not address: {topic}. My knowledge is limited to the legally indexed materials.']

# English terms and their Hindi, in order.
HINDI_TERMS = {'murder': 'हत्या',
 'theft': 'चोरी',
 'robbery': 'डकैती',
 'rape': 'बलात्कार',
 'assault': 'हमला',
 'kidnapping': 'अपहरण',
 'extortion': 'उगाही',
 'forgery': 'जालसाजी',
 'cheating': 'धोखाधड़ी',
 'criminal breach of trust': 'आपराधिक विश्वासघात',
 'private defence': 'स्वप्रतिरक्षा',
 'abetment': 'उकसाना',
 'conspiracy': 'षड्यंत्र',
 'offence': 'अपराध',
 'punishment': 'दंड',
 'imprisonment': 'कारावास',
 'fine': 'जुर्माना',
 'bail': 'जमानत',
 'arrest': 'गिरफ्तारी',
 'investigation': 'जांच',
 'trial': 'विचारण',
 'judgment': 'निर्णय',
 'appeal': 'अपील',
 'sentence': 'सजा',
 'acquittal': 'रिहाई',
 'conviction': 'सिद्धांत',
 ' FIR': 'प्रथम सूचना रिपोर्ट',
 'cognizable': 'संज्ञेय',
 'non-cognizable': 'असंज्ञेय',
 'compoundable': 'समझौता योग्य',
 'non-compoundable': 'असमझौता योग्य',
 'warrant': 'वारंट',
 'summons': 'समन',
 'charge': 'आरोप',
 'evidence': 'साक्ष्य',
 'witness': 'गवाह',
 'statement': 'बयान',
 'confession': 'स्वीकारोक्ति',
 'supreme court': 'सर्वोच्च न्यायालय',
 'high court': 'उच्च न्यायालय',
 'district court': 'जिला न्यायालय',
 'magistrate': 'मजिस्ट्रेट',
 'judge': 'न्यायाधीश',
 'advocate': 'वकील',
 'plaintiff': 'वादी',
 'defendant': 'प्रतिवादी',
 'accused': 'आरोपी',
 'complainant': 'शिकायतकर्ता',
 'court': 'न्यायालय',
 'bar association': 'बार संघ',
 'civil': 'नागरिक',
 'suit': 'वाद',
 'decree': 'आदेश',
 'execution': 'निष्पादन',
 'decree holder': 'आदेशधारक',
 'judgment debtor': 'ऋणी',
 'limitation': 'सीमा',
 'mesne profit': 'मध्यवर्ती लाभ',
 'injunction': 'याचिका',
 'property': 'संपत्ति',
 'land': 'भूमि',
 'house': 'मकान',
 'rent': 'किराया',
 'tenant': 'किरायेदार',
 'landlord': 'मकान मालिक',
 'marriage': 'विवाह',
 'divorce': 'तलाक',
 'maintenance': 'गुजारा',
 'alimony': 'वैवाहिक भरण',
 'guardianship': 'संरक्षण',
 'succession': 'उत्तराधिकार',
 'inheritance': 'विरासत',
 'will': 'वसीयत',
 'law': 'कानून',
 'act': 'अधिनियम',
 'section': 'धारा',
 'chapter': 'अध्याय',
 'article': 'अनुच्छेद',
 'clause': 'खंड',
 'schedule': 'अनुसूची'}

# Hindi number words.
HINDI_NUMBERS = {'ek': '1',
 'do': '2',
 'teen': '3',
 'char': '4',
 'paanch': '5',
 'chah': '6',
 'saat': '7',
 'aath': '8',
 'nau': '9',
 'das': '10',
 'gyarah': '11',
 'barah': '12',
 'terah': '13',
 'choudah': '14',
 'pandrah': '15',
 'solah': '16',
 'satrah': '17',
 'atharah': '18',
 'unnis': '19',
 'bees': '20'}

# Devanagari letters in Roman.
ROMAN_LETTERS = {'अ': 'a',
 'आ': 'aa',
 'इ': 'i',
 'ई': 'ee',
 'उ': 'u',
 'ऊ': 'oo',
 'ऋ': 'ri',
 'ए': 'e',
 'ऐ': 'ai',
 'ओ': 'o',
 'औ': 'au',
 'क': 'k',
 'ख': 'kh',
 'ग': 'g',
 'घ': 'gh',
 'ङ': 'ng',
 'च': 'ch',
 'छ': 'chh',
 'ज': 'j',
 'झ': 'jh',
 'ञ': 'n',
 'ट': 'T',
 'ठ': 'Th',
 'ड': 'D',
 'ढ': 'Dh',
 'ण': 'N',
 'त': 't',
 'थ': 'th',
 'द': 'd',
 'ध': 'dh',
 'न': 'n',
 'प': 'p',
 'फ': 'ph',
 'ब': 'b',
 'भ': 'bh',
 'म': 'm',
 'य': 'y',
 'र': 'r',
 'ल': 'l',
 'व': 'v',
 'श': 'sh',
 'ष': 'Sh',
 'स': 's',
 'ह': 'h',
 'ा': 'aa',
 'ि': 'i',
 'ी': 'ee',
 'ु': 'u',
 'ू': 'oo',
 'ृ': 'ri',
 'े': 'e',
 'ै': 'ai',
 'ो': 'o',
 'ौ': 'au',
 'ं': 'n',
 'ः': 'h'}

# Civil acts in order.
CIVIL_ACTS = ['Code of Civil Procedure', 'CPC', 'Civil Procedure Code', 'Indian Contract Act', 'Contract Act 1872', 'Transfer of Property Act',
 'Property Act 1882', 'Hindu Marriage Act', 'Hindu Marriage Act 1955', 'Hindu Succession Act', 'Hindu Succession Act 1956', 'Indian Succession Act',
 'Limitation Act', 'Registration Act', 'Specific Relief Act', 'Trust Act', 'Partition Act', 'Easements Act']

# Words of civil law.
CIVIL_WORDS = ('cpc', 'civil procedure', 'code of civil procedure', 'civil court', 'district court', 'high court civil', 'civil suit', 'plaint',
 'written statement', 'decree', 'execution', 'limitation', 'limitation act', 'civil appeal', 'civil revision', 'civil misc', 'cmc', 'cmm',
 'small cause', 'rent act', 'tenancy', 'eviction', 'landlord', 'tenant', 'partition', 'succession', 'heir', 'inheritance', 'will', 'probate',
 'letters of administration', 'contract act', 'agreement', 'breach of contract', 'specific performance', 'indemnity', 'guarantee', 'bailment',
 'pledge', 'agency', 'partnership', 'sale of goods', 'conditional sale', 'hire purchase', 'hindu marriage', 'hindu succession', 'hindu adoption',
 'hindu minority', 'maintenance', 'alimony', 'divorce', 'judicial separation', 'restitution', 'dowry', 'stridhan', 'transfer of property',
 'sale deed', 'gift deed', 'mortgage', 'lease', 'license', 'easement', 'title', 'conveyance', 'injunction', 'declaratory', 'recovery', 'money suit',
 'compensation', 'damages', 'specific relief', 'res judicata', 'collateral estoppel', 'issue estoppel', 'principle of merger')

# Words of civil procedure.
PROCEDURE_WORDS = ('order 1', 'order 2', 'order 6', 'order 7', 'order 8', 'order 9', 'order 11', 'order 12', 'order 21', 'order 22', 'order 23', 'order 32', 'order 39',
 'order 47', 'order 49', 'rule 1', 'rule 2', 'schedule', 'form', 'appendix', 'valuation', 'jurisdiction', 'place of suing', 'institution of suit',
 'parties', 'joinder', 'misjoinder', 'pleadings', 'written statement', 'replication', 'amendment', 'examination', 'admission', 'interrogatories',
 'discovery', 'inspection', 'production of documents', 'commission', 'interim application', 'temporary injunction', 'temporary relief', 'appeal',
 'second appeal', ' Letters Patent Appeal', 'special appeal', 'revision', 'review', 'review application', 'caveat', 'locus standi', 'cause of action',
 'limitation period', 'condonation of delay', 'estoppel', 'waiver', 'res judicata', 'constructive res judicata', 'federal conflict',
 'cross-examination', 'evidence', 'documentary evidence', 'oral evidence', 'burden of proof', 'presumption', 'fiction of law', 'document', 'plaint',
 'written statement', 'memo of parties', 'title', 'valuation', 'court fee', 'process fee', 'summons', 'service of summons', 'substituted service',
 'efflux of time', 'ex parte', 'default judgment', 'decree', 'decree holder', 'judgment debtor', 'execution', 'execution application', 'attachment',
 'sale', 'delivery', 'mesne profit', 'accounting', 'appointment of receiver', 'temporary injunction', 'permanent injunction', 'mandatory injunction',
 'prohibitory injunction', 'declaration', 'cancellation', 'specific performance', 'rescission', 'reformation', 'rectification')

# Kinds of Hindi documents.
HINDI_DOCUMENTS = {'fir': ['प्रथम सूचना रिपोर्ट', 'FIR'],
 'charge_sheet': ['आरोप पत्र', 'चार्जशीट'],
 'judgment': ['निर्णय', 'Judgment'],
 'petition': ['याचिका', 'Petition'],
 'affidavit': ['हलफनामा', 'Affidavit'],
 'contract': ['अनुबंध', 'Contract'],
 'notice': ['नोटिस', 'Notice']}
# Words that are no keywords in evaluation.
KEYWORD_STOP_WORDS = ('the', 'a', 'an', 'is', 'are', 'was', 'were', 'be', 'been', 'being', 'have', 'has', 'had', 'do', 'does', 'did', 'will', 'would', 'could', 'should',
 'may', 'might', 'shall', 'can', 'need', 'dare', 'ought', 'used', 'to', 'of', 'in', 'for', 'on', 'with', 'at', 'by', 'from', 'as', 'into', 'through',
 'during', 'before', 'after', 'above', 'below', 'between', 'out', 'off', 'over', 'under', 'again', 'further', 'then', 'once', 'here', 'there', 'when',
 'where', 'why', 'how', 'all', 'both', 'each', 'few', 'more', 'most', 'other', 'some', 'such', 'no', 'nor', 'not', 'only', 'own', 'same', 'so',
 'than', 'too', 'very', 'just', 'and', 'but', 'or', 'if', 'while', 'what', 'which', 'who', 'whom', 'this', 'that', 'these', 'those', 'i', 'me', 'my',
 'we', 'our', 'you', 'your', 'he', 'him', 'his', 'she', 'her', 'it', 'its', 'they', 'them', 'their', 'about', 'up', 'also', 'section', 'ipc', 'bns',
 'crpc', 'bnss', 'bsa', 'act', 'code', 'law', 'case')

# Phrases that mark a legal query.
LEGAL_INTENT_PHRASES = (
    "high court", "supreme court", "consumer protection", "industrial dispute", "motor vehicle", "right to",
    "fundamental right", "legal remedy", "legal option", "what is the punishment", "is it a crime", "can i file",
)

# Civil acts by key: name, short name, year, effective date, sections.
CIVIL_CATALOGUE = {
    "cpc": ("Code of Civil Procedure, 1908", "CPC", 1908, "01-01-1909", 158),
    "contract": ("Indian Contract Act, 1872", "ICA", 1872, "01-09-1872", 238),
    "transfer": ("Transfer of Property Act, 1882", "TPA", 1882, "01-07-1882", 137),
    "hindu_marriage": ("Hindu Marriage Act, 1955", "HMA", 1955, "18-05-1955", 37),
    "hindu_succession": ("Hindu Succession Act, 1956", "HSA", 1956, "17-06-1956", 40),
    "specific_relief": ("Specific Relief Act, 1963", "SRA", 1963, "01-07-1964", 22),
    "limitation": ("Limitation Act, 1963", "LA", 1963, "01-01-1964", 35),
    "registration": ("Indian Registration Act, 1908", "RA", 1908, "01-01-1909", 82),
}

# Redaction rules, pattern and replacement.
REDACTIONS = (
    (r"(api[_-]?key[=:]\s*)([\w\-]{20,})", "$1[REDACTED]"),
    (r"(X-API-Key[:\s]+)([\w\-]{20,})", "$1[REDACTED]"),
    (r"(Bearer\s+)([\w\-]+\.[\w\-]+\.[\w\-]+)", "$1[REDACTED_JWT]"),
    (r"(access[_-]?token[=:]\s*)([\w\-]+\.[\w\-]+\.[\w\-]+)", "$1[REDACTED_JWT]"),
    (r"(password[=:]\s*)(\S+)", "$1[REDACTED]"),
    (r"(POSTGRES_PASSWORD[=:]\s*)(\S+)", "$1[REDACTED]"),
    (r"(jwt[_-]?secret[=:]\s*)(\S+)", "$1[REDACTED]"),
    (r"(secret[_-]?key[=:]\s*)(\S+)", "$1[REDACTED]"),
    (r"(gsk_\w{4})(\w{16,})", "$1[REDACTED]"),
    (r"(postgresql://\w+:\w+@)", "postgresql://[REDACTED]:[REDACTED]@"),
    (r"(redis://:\w+@)", "redis://:[REDACTED]@"),
)
SECRET_KEYS = ("api_key", "apikey", "password", "secret", "jwt_secret", "secret_key", "access_token", "authorization", "token", "jwtsecret", "x_api_key")

# Patterns of reported cases.
CITATION_PATTERNS = (
    r"\bAIR\s+\d{4}\s+[A-Z]+\s+\d+\b",
    r"\bSCALE\s+\d{4}\s+[A-Z]+\s+\d+\b",
    r"\bSCC\s+\d{4}\s+[A-Z]+\s+\d+\b",
    r"\b\d{1,2}\s*SCC\s*\(\d{4}\)",
    r"\bILR\s+\d{4}\s+[A-Z]+\s+\d+\b",
    r"\(\d{4}\)\s*\d+\s*SC[RT]?\b",
    r"\(\d{4}\)\s*\d+\s*CLT\b",
)

# Courts by key, as their names occur in texts, in order.
COURT_KEYS = (
    ("supreme court", "supreme_court"),
    ("delhi", "delhi_high_court"),
    ("bombay", "bombay_high_court"),
    ("mumbai", "bombay_high_court"),
    ("madras", "madras_high_court"),
    ("chennai", "madras_high_court"),
    ("calcutta", "calcutta_high_court"),
    ("kolkata", "calcutta_high_court"),
)

#: Fixed value: where sections, chapters and parts start.
SECTION_STARTS = r"(?m)(?:(?:^|\n)(?:Section|Sec\.?|s\.)\s*\d{1,4}[A-Z]?\.|(?:^|\n)\d{1,4}[A-Z]?\.\s+[A-Z]|(?:^|\n)(?:CHAPTER|Chapter|PART|Part)\s+(?:\d+|[A-Z]+))"

#: Patterns of the query parser, in the order in which they count; case is ignored.
SECTION_PATTERNS = (
    r"section[s]?\s+(\d{1,4}[a-z]?)\s+(?:of\s+)?(ipc|bns|crpc|bnss)",
    r"section[s]?\s+(\d{1,4}[a-z]?)\s+(?:and|,)\s+(\d{1,4}[a-z]?)\s+(ipc|bns|crpc|bnss)",
    r"section[s]?\s+(\d{1,4}[a-z]?)",
    r"(?:s|sec|sec\.|section)\.?\s*(\d{1,4}[a-z]?)",
    r"\[s\.?\s*(\d{1,4}[a-z]?)\]",
)
ARTICLE_PATTERNS = (
    r"article\s+(\d{1,4}[a-z]?)\s+(?:of\s+(?:the\s+)?constitution)?",
    r"art\.?\s*(\d{1,4}[a-z]?)",
)

#: Patterns and names of the query analysis. {act} stands for each of SECTION_ACTS.
QUERY_SECTION = r"\bsection\s+(\d+[a-z]?)\b"
QUERY_TARGET_PATTERNS = (
    r"\bnow\b[^.]*?\bsection\s+(\d+[a-z]?)\b",
    r"\bcorresponds?\s+to\b[^.]*?\bsection\s+(\d+[a-z]?)\b",
    r"\bequivalent\b[^.]*?\bsection\s+(\d+[a-z]?)\b",
)
SECTION_ACTS = ("ipc", "bns", "crpc", "bnss")
QUERY_SECTION_PATTERNS = (
    r"\b{act}\b[^.]*?\bsection\s+(\d+[a-z]?)\b",
    r"\bsection\s+(\d+[a-z]?)\b[^.]*?\b{act}\b",
)
ACT_PAIRS = (("ipc", "bns"), ("crpc", "bnss"))
QUERY_ACT_PHRASES = {
    "ipc": "indian penal code",
    "bns": "bharatiya nyaya sanhita",
    "crpc": "code of criminal procedure",
    "bnss": "bharatiya nagarik suraksha sanhita",
}
QUERY_SAYS_ACT = (
    r"\b(ipc|bns|crpc|bnss|bsa|cpc|act)\b|indian penal code|bharatiya nyaya sanhita|code of criminal procedure|bharatiya nagarik suraksha sanhita|bharatiya sakshya adhiniyam"
    r"|indian evidence act|transfer of property act|consumer protection act|ndps|narcotic|motor vehicles act|hindu succession|indian contract act|limitation act"
)
