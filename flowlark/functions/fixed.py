"""Labels, thresholds, knowledge tables. These must be equal to the published ones."""

# --- fixed values: label cleaning, raw text -> clean label -------------------------------
LABEL_FIXES = {
    "Web Attack – Brute Force": "WebAttack_BruteForce",
    "Web Attack - Brute Force": "WebAttack_BruteForce",
    "Web Attack � Brute Force": "WebAttack_BruteForce",
    "Web Attack – XSS": "WebAttack_XSS",
    "Web Attack - XSS": "WebAttack_XSS",
    "Web Attack � XSS": "WebAttack_XSS",
    "Web Attack – Sql Injection": "WebAttack_SQLInjection",
    "Web Attack - Sql Injection": "WebAttack_SQLInjection",
    "Web Attack � Sql Injection": "WebAttack_SQLInjection",
}

# --- fixed values: source file -> split --------------------------------------------------
SPLIT_FILES = [
    ("Monday-WorkingHours.pcap_ISCX.csv", "train"),
    ("Tuesday-WorkingHours.pcap_ISCX.csv", "train"),
    ("Wednesday-workingHours.pcap_ISCX.csv", "train"),
    ("Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv", "valid"),
    ("Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv", "valid"),
    ("Friday-WorkingHours-Morning.pcap_ISCX.csv", "test"),
    ("Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv", "test"),
    ("Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv", "test"),
]

# --- fixed values: label -> ATT&CK (id, technique, tactic) used by alert correlation ------
CORRELATION_MITRE = [
    ("DDoS", "T1498", "Network Denial of Service", "Impact"),
    ("DoS Hulk", "T1499", "Endpoint Denial of Service", "Impact"),
    ("DoS GoldenEye", "T1499", "Endpoint Denial of Service", "Impact"),
    ("DoS slowloris", "T1499", "Endpoint Denial of Service", "Impact"),
    ("DoS Slowhttptest", "T1499", "Endpoint Denial of Service", "Impact"),
    ("PortScan", "T1046", "Network Service Discovery", "Discovery"),
    ("FTP-Patator", "T1110", "Brute Force", "Credential Access"),
    ("SSH-Patator", "T1110", "Brute Force", "Credential Access"),
    ("Bot", "T1071", "Application Layer Protocol", "Command and Control"),
    ("WebAttack_BruteForce", "T1110", "Brute Force", "Credential Access"),
    ("WebAttack_XSS", "T1059", "Scripting", "Execution"),
    ("WebAttack_SQLInjection", "T1190", "Exploit Public-Facing Application", "Initial Access"),
    ("Infiltration", "T1078", "Valid Accounts", "Defense Evasion"),
    ("Heartbleed", "T1190", "Exploit Public-Facing Application", "Initial Access"),
    ("BENIGN", "—", "—", "—"),
]
UNKNOWN_MITRE = ("T????", "Unknown Technique", "Unknown Tactic")

# --- fixed values: correlation thresholds -------------------------------------------------
ALERT_THRESHOLD = 3
HIGH_COUNT = 10
CRITICAL_COUNT = 25

# --- fixed values: ATT&CK tactics in kill-chain order ------------------------------------
TACTICS = [
    "Reconnaissance",
    "Resource Development",
    "Initial Access",
    "Execution",
    "Persistence",
    "Privilege Escalation",
    "Defense Evasion",
    "Credential Access",
    "Discovery",
    "Lateral Movement",
    "Collection",
    "Command and Control",
    "Exfiltration",
    "Impact",
]

# --- fixed values: playbook per label -----------------------------------------------------
# label | summary | tactics (id, name) | techniques (id, name)
PLAYBOOK = [
    ("PortScan", "The flow pattern is consistent with adversary service discovery prior to exploitation.",
     [("TA0043", "Reconnaissance")], [("T1595", "Active Scanning")]),
    ("FTP-Patator", "Repeated login attempts suggest password guessing against exposed FTP services.",
     [("TA0006", "Credential Access")], [("T1110", "Brute Force")]),
    ("SSH-Patator", "Repeated authentication failures are aligned with SSH brute-force activity.",
     [("TA0006", "Credential Access")], [("T1110", "Brute Force")]),
    ("WebAttack_BruteForce", "The traffic resembles credential stuffing or brute-force attempts against a web-facing login.",
     [("TA0006", "Credential Access"), ("TA0001", "Initial Access")],
     [("T1110", "Brute Force"), ("T1190", "Exploit Public-Facing Application")]),
    ("WebAttack_SQLInjection", "The activity maps to exploitation of a public-facing application through malicious input.",
     [("TA0001", "Initial Access"), ("TA0009", "Collection")], [("T1190", "Exploit Public-Facing Application")]),
    ("WebAttack_XSS", "The traffic suggests input-driven exploitation of a public-facing application.",
     [("TA0001", "Initial Access"), ("TA0002", "Execution")],
     [("T1190", "Exploit Public-Facing Application"), ("T1059.007", "JavaScript")]),
    ("Infiltration", "This label points to follow-on malicious activity after initial compromise or payload delivery.",
     [("TA0001", "Initial Access"), ("TA0011", "Command and Control")],
     [("T1190", "Exploit Public-Facing Application"), ("T1071", "Application Layer Protocol")]),
    ("Bot", "The communication pattern suggests a compromised host participating in botnet activity.",
     [("TA0011", "Command and Control")], [("T1071", "Application Layer Protocol")]),
    ("Heartbleed", "The flow aligns with exploitation of a vulnerable public-facing service.",
     [("TA0001", "Initial Access"), ("TA0006", "Credential Access")], [("T1190", "Exploit Public-Facing Application")]),
    ("DDoS", "The event reflects an availability attack intended to saturate network capacity.",
     [("TA0040", "Impact")], [("T1498", "Network Denial of Service")]),
    ("DoS Hulk", "The flow suggests a high-rate denial-of-service attempt against a service endpoint.",
     [("TA0040", "Impact")], [("T1499", "Endpoint Denial of Service")]),
    ("DoS GoldenEye", "The traffic pattern is consistent with an application-layer denial-of-service attempt.",
     [("TA0040", "Impact")], [("T1499", "Endpoint Denial of Service")]),
    ("DoS slowloris", "The event resembles slow HTTP connection abuse aimed at tying up server sockets.",
     [("TA0040", "Impact")], [("T1499", "Endpoint Denial of Service")]),
    ("DoS Slowhttptest", "The observed pattern matches slow-request flooding against an application endpoint.",
     [("TA0040", "Impact")], [("T1499", "Endpoint Denial of Service")]),
]

# label | step | phase | technique id | technique | description
PLAYBOOK_STEPS = [
    ("PortScan", 1, "Reconnaissance", "T1595", "Active Scanning",
     "The adversary probes reachable hosts and open services to identify viable targets."),
    ("FTP-Patator", 1, "Credential Access", "T1110", "Brute Force",
     "The adversary cycles credentials against an FTP login surface."),
    ("SSH-Patator", 1, "Credential Access", "T1110", "Brute Force",
     "The adversary attempts to recover valid SSH credentials through repeated guesses."),
    ("WebAttack_BruteForce", 1, "Credential Access", "T1110", "Brute Force",
     "The adversary targets a web authentication workflow with repeated guesses."),
    ("WebAttack_BruteForce", 2, "Initial Access", "T1190", "Exploit Public-Facing Application",
     "Successful credential compromise can become a path into the application environment."),
    ("WebAttack_SQLInjection", 1, "Initial Access", "T1190", "Exploit Public-Facing Application",
     "The adversary sends crafted SQL payloads to abuse exposed application logic."),
    ("WebAttack_SQLInjection", 2, "Collection", "T1190", "Exploit Public-Facing Application",
     "A successful injection can expose or extract application data from the backing store."),
    ("WebAttack_XSS", 1, "Initial Access", "T1190", "Exploit Public-Facing Application",
     "The adversary abuses unsafe input handling on the exposed web application."),
    ("WebAttack_XSS", 2, "Execution", "T1059.007", "JavaScript",
     "Injected script can execute in a victim browser if the payload is reflected or stored."),
    ("Infiltration", 1, "Initial Access", "T1190", "Exploit Public-Facing Application",
     "The adversary gains a foothold through an exposed service or application path."),
    ("Infiltration", 2, "Command and Control", "T1071", "Application Layer Protocol",
     "Follow-on traffic suggests post-compromise communications over common application protocols."),
    ("Bot", 1, "Command and Control", "T1071", "Application Layer Protocol",
     "The compromised host appears to maintain command-and-control traffic with an operator."),
    ("Heartbleed", 1, "Initial Access", "T1190", "Exploit Public-Facing Application",
     "The adversary attempts to abuse a vulnerable service exposed to the network."),
    ("Heartbleed", 2, "Credential Access", "T1190", "Exploit Public-Facing Application",
     "Memory disclosure from the exploit can expose session material or secrets."),
    ("DDoS", 1, "Impact", "T1498", "Network Denial of Service",
     "Distributed traffic volume is used to degrade or disrupt a service."),
    ("DoS Hulk", 1, "Impact", "T1499", "Endpoint Denial of Service",
     "The adversary attempts to exhaust application or host resources on the target."),
    ("DoS GoldenEye", 1, "Impact", "T1499", "Endpoint Denial of Service",
     "The adversary targets server-side resources to degrade service availability."),
    ("DoS slowloris", 1, "Impact", "T1499", "Endpoint Denial of Service",
     "The adversary holds connections open to exhaust the target's available capacity."),
    ("DoS Slowhttptest", 1, "Impact", "T1499", "Endpoint Denial of Service",
     "Slow or partial requests are used to keep server resources occupied."),
]

# --- fixed values: playbook of any label without an entry ---------------------------------
TRIAGE_SUMMARY = "An anomaly was detected, but there is not enough signal to map it to a single ATT&CK technique."
TRIAGE_STEP = (1, "Triage", None, None,
               "Review the anomalous flow, enrich it with host and identity telemetry, and assign a final ATT&CK mapping.")

# --- fixed values: base severity per attack type ------------------------------------------
SEVERITY_BASE = [
    ("UNKNOWN_ANOMALY", 45),
    ("PortScan", 50),
    ("WebAttack_BruteForce", 60),
    ("WebAttack_XSS", 60),
    ("FTP-Patator", 70),
    ("SSH-Patator", 70),
    ("WebAttack_SQLInjection", 80),
    ("Bot", 80),
    ("Infiltration", 85),
    ("DoS Hulk", 85),
    ("DoS GoldenEye", 85),
    ("DoS slowloris", 85),
    ("DoS Slowhttptest", 85),
    ("Heartbleed", 90),
    ("DDoS", 95),
]
SEVERITY_DEFAULT = 55

# --- fixed values: specialist routing -----------------------------------------------------
WEB_FAMILY = ["WebAttack_BruteForce", "WebAttack_XSS", "WebAttack_SQLInjection", "Infiltration"]
ADJACENT = ["DoS slowloris", "DoS GoldenEye", "DoS Hulk", "DoS Slowhttptest", "BENIGN", "FTP-Patator"]
ROUTE_CONFIDENCE = 0.80

# --- fixed values: defaults of a flow record ----------------------------------------------
FLOW_TEXT_DEFAULTS = {"src_ip": "192.168.1.10", "dst_ip": "192.168.1.1", "protocol": "TCP",
                      "tcp_flags": "SYN", "label": "unknown"}
FLOW_REAL = ["duration", "packet_rate", "byte_rate", "avg_packet_size"]
FLOW_WHOLE = ["src_port", "dst_port", "total_packets", "total_bytes", "packets_src_to_dst",
              "packets_dst_to_src", "bytes_src_to_dst", "bytes_dst_to_src"]

# --- fixed values: columns that are metadata, not model input ------------------------------
METADATA = ["flow_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "sensor_id", "asset_id",
            "hostname", "username", "label", "Label", "dataset", "source_file", "source_split"]

# --- fixed values: the 78 flow features, in order ------------------------------------------
FLOW_FEATURES = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count",
    "URG Flag Count", "CWE Flag Count", "ECE Flag Count", "Down/Up Ratio", "Average Packet Size",
    "Avg Fwd Segment Size", "Avg Bwd Segment Size", "Fwd Header Length.1",
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward",
    "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

# --- fixed values: how many newest entries each view keeps ---------------------------------
RECENT = {"feed": 250, "alerts": 150, "suspicious": 150, "flows": 5000, "insights": 250,
          "alert_records": 250, "incidents": 150}
